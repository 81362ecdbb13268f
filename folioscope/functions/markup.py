"""Answers for channels: safe HTML, plain text, paragraphs for the web, messages of bounded length.

A text is read once into nodes; each channel has a renderer over them.  Marks that are never closed, and
signs like ``<600V`` that open no tag, are plain text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that the HTML channel shows.
SAFE_TAGS = ("b", "strong", "i", "em", "u", "ins", "s", "strike", "del", "code", "pre", "a")


class Node(NamedTuple):
    kind: str
    #: What stands in the text.
    source: str
    #: What the mark encloses, and a link's address.
    inner: str = ""
    address: str = ""


#: One alternative for each kind of node; the first that matches at a place is taken.
_GRAMMAR = re.compile(
    r"""
      (?P<pre><pre\b[^>]*>(?P<pre_in>.*?)</pre>)
    | (?P<fence>```[^\n`]*\n(?P<fence_in>.*?)```)
    | (?P<tag></?(?P<name>[A-Za-z][A-Za-z0-9]*)\b[^<>]*>)
    | (?P<link>\[(?P<link_in>[^\]\n]+)\]\((?P<url>https?://[^)\s]+)\))
    | (?P<code>`(?P<code_in>[^`\n]+)`)
    | (?P<strong>(?P<two>\*\*|__)(?P<strong_in>(?:(?!(?P=two))[^\n])+)(?P=two))
    | (?P<soft>(?<!\*)\*(?P<star_in>[^*\n]+)\*(?!\*)|(?<!\w)_(?P<line_in>[^_\n]+)_(?!\w))
    | (?P<head>(?m:^)[\ \t]{0,3}\#{1,6}[\ \t]+(?P<head_in>[^\n]*[^\s])[\ \t]*(?=\n|\Z))
    | (?P<item>(?m:^)(?P<indent>[\ \t]*)[-+][\ \t]+)
    """,
    re.VERBOSE | re.DOTALL | re.IGNORECASE,
)


def nodes(text: str) -> Iterator[Node]:
    """The text as nodes, in order; their sources joined are the text."""
    at = 0
    for m in _GRAMMAR.finditer(text):
        if m.start() > at:
            yield Node("text", text[at : m.start()])
        kind = next(k for k in ("pre", "fence", "tag", "link", "code", "strong", "soft", "head", "item") if m[k] is not None)
        inner = {"tag": m["name"], "soft": m["star_in"] or m["line_in"], "item": m["indent"]}.get(kind) if kind in ("tag", "soft", "item") else m[f"{kind}_in"]
        yield Node(kind, m[0], inner or "", m["url"] or "")
        at = m.end()
    if at < len(text):
        yield Node("text", text[at:])


def _as_html(node: Node) -> str:
    match node.kind:
        case "pre":
            return node.source
        case "fence":
            return f"<pre>{html.escape(node.inner.strip())}</pre>"
        case "tag":
            return node.source if node.inner.lower() in SAFE_TAGS else ""
        case "link":
            return f'<a href="{html.escape(node.address)}">{html.escape(node.inner.strip())}</a>'
        case "code":
            return f"<code>{html.escape(node.inner)}</code>"
        case "strong" | "head":
            return f"<b>{_html(node.inner)}</b>"
        case "soft":
            return f"<i>{_html(node.inner)}</i>"
        case "item":
            return f"{node.inner}• "
    return html.escape(node.source)


def _html(text: str | None) -> str:
    return "".join(map(_as_html, nodes(text or "")))


def _plain(text: str | None) -> str:
    """Tags go, preformatted blocks become fences, entities their characters; other marks stay as they are."""
    shown = {"pre": lambda n: f"```{n.inner}```", "tag": lambda n: ""}
    return html.unescape("".join(shown.get(n.kind, lambda n: n.source)(n) for n in nodes(text or ""))).strip()


def _web(text: str | None) -> str:
    paragraphs: list[list[str]] = [[]]
    for line in _html(text).split("\n"):
        if line:
            paragraphs[-1].append(line)
        elif paragraphs[-1]:
            paragraphs.append([])
    return "\n".join(f"<p>{'<br>'.join(lines)}</p>" for lines in paragraphs if any(x.strip() for x in lines))


def _mapped(step):
    def column(text: Column) -> Column:
        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(step)

        return run(text)

    return column


channel_html, plain_text, web_html = _mapped(_html), _mapped(_plain), _mapped(_web)

#: Channel, the format's name and its renderer.
CHANNELS = (("telegram", "telegram_html", channel_html), ("whatsapp", "whatsapp_text", plain_text), ("web", "web_html", web_html))


def for_channel(text: Column, channel: Column) -> Column:
    """struct(text, format) for the channels above (none named: the first), or anything else as it is."""
    asked = F.lower(F.coalesce(channel, F.lit(CHANNELS[0][0])))
    out, kind = text, F.lit("plain_text")
    for name, form, render in CHANNELS:
        out, kind = F.when(asked == name, render(text)).otherwise(out), F.when(asked == name, form).otherwise(kind)
    return F.struct(out.alias("text"), kind.alias("format"))


def safe_tags_only(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?i)<(?!/?(?:{'|'.join(SAFE_TAGS)})\b)[^>]+>", "")


def message_spans(text: str, limit: int) -> list[tuple[int, int]]:
    """Where the messages of a text begin and end.

    The breaks of a text are the gaps between paragraphs and the edges of preformatted blocks, none inside
    of these.  A message ends at the last break that it reaches; without one, at the last line end of its
    second half, else at its limit.
    """
    blocks = [(m.start(), m.end()) for m in re.finditer(r"(?is)<pre\b[^>]*>.*?</pre>", text)]
    inside = lambda at: any(a < at < b for a, b in blocks)
    gaps = [(m.start(), m.end()) for m in re.finditer(r"\n{2,}", text) if not inside(m.start())]
    ended = {b for _, b in gaps}  # an edge at which a gap ends is no other break
    breaks = sorted({*gaps, *((e, e) for block in blocks for e in block if e not in ended)})
    starts = [a for a, _ in breaks]
    out, at = [], 0
    while len(text) - at > limit:
        k = bisect_right(starts, at + limit) - 1
        if k >= 0 and starts[k] > at:
            end, following = breaks[k]
        else:
            line = text.rfind("\n", at + limit // 2, at + limit)
            end = following = line if line > at else at + limit
        out.append((at, end))
        at = following
        while at < len(text) and text[at] == "\n":
            at += 1
    return [*out, (at, len(text))] if at < len(text) or not out else out


def messages(text: Column, limit: int = 4000) -> Column:
    """Parts of at most ``limit`` characters; a null or blank text is one empty or unchanged part."""

    def one(whole: str | None) -> list[str]:
        whole = whole or ""
        parts = [whole[a:b].strip("\n") for a, b in message_spans(whole, limit)] if len(whole) > limit else [whole]
        return [p for p in parts if p.strip()] or [whole[:limit]]

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(text)
