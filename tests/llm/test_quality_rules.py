import re
from collections import Counter

from folioscope.llm.quality_rules import quality_rules
from tests.llm.helpers import documents, texts


def brute(text, min_repeat=8, max_covered=0.3, max_longest=100):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    three = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    hit = set()
    for i in range(n - 2):
        if three[tuple(words[i : i + 3])] > 1:
            hit.update((i, i + 1, i + 2))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    longest, cover = 0, set()
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        longest = max(longest, best)
        if best >= min_repeat:
            cover.update(range(i, i + best))
    failed = n < 50 or 100 * len(hit) > 50 * n
    kept = not failed and len(cover) <= max_covered * n and longest <= max_longest
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed, len(cover), longest, kept


def test_against_brute_force(spark):
    rows = texts()
    rows += [rows[12] + " " + rows[12], (rows[12] or "") + "\n" + (rows[14] or "") + "\n" + (rows[12] or ""), "# a | b\n# a | b\n<x> & %"]
    got = quality_rules(documents(spark, rows, extra=["n_words", "kept"])).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {i: brute(t) for i, t in enumerate(rows)}


def test_empty_table(spark):
    assert quality_rules(documents(spark, ["x"]).limit(0)).collect() == []


def test_a_very_long_text(spark):
    words = [f"w{i}" for i in range(200_000)]
    text = " ".join(words + words[100:160])
    chars = sum(map(len, words)) + sum(map(len, words[100:160]))
    got = tuple(quality_rules(documents(spark, [text])).first())[1:]
    assert got == (200_060, chars, 0, 0, 120, False, 120, 60, True)
