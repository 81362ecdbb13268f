"""Questions and answers as columns: intent, references, fidelity, model output, history, citations, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.text import TABLE_ID, any_case, collapse_elongations

# The vocabulary that decides the intent, and the fields of a model's answer.
STOPWORDS = (
    "que", "qué", "es", "son", "el", "la", "los", "las", "un", "una", "unos",
    "unas", "de", "del", "al", "en", "con", "por", "para", "se", "su", "sus",
    "lo", "le", "me", "mi", "tu", "te", "como", "cómo", "cual", "cuál", "cuales",
    "cuáles", "eso", "esa", "ese", "esto", "esta", "este", "asi", "así", "mas",
    "más", "muy", "ya", "hay", "sobre", "cuanto", "cuánto", "cuando", "cuándo",
)
GREETING = (
    r"(?:hola+|holi+|holis+|buen[oa]s(?:\s+(?:d[ií]as|tardes|noches))?"
    r"|hey+|hello+|hi+|saludos|qu[eé]\s+tal|qu[eé]\s+m[aá]s|c[oó]mo\s+est[aá]s"
    r"|(?:muchas\s+)?gracias+|ok(?:ey)?|vale|listo|perfecto|genial|excelente|de\s+nada"
    r"|adi[oó]s|hasta\s+luego|cha[uo]+|nos\s+vemos"
    r"|qu[ié][eé]n\s+eres|qu[eé]\s+puedes\s+hacer|ayuda)"
)
ASKS_TABLE = r"\btablas?\b"
ASKS_COMPARISON = r"\b(diferencias?|comparar?|comparaci[oó]n|versus|vs\.?|frente\s+a|cu[aá]l\s+es\s+mejor|en\s+qu[eé]\s+se\s+diferencian?)\b"
ASKS_ALL = (
    r"\b(todos?|todas?|completas?|completos?|sin\s+omitir|lista\s+completa|"
    r"al\s+pie\s+de\s+la\s+letra|literal(?:es)?|numerales?|cada\s+uno|exhaustiv[oa]s?|"
    r"requerimientos?|requisitos?|exigencias?|obligaci[oó]n(?:es)?|condici[oó]n(?:es)?|"
    r"qu[eé]\s+(?:exige|requiere|requieren|establece|establecen|dispone|determina|"
    r"se[ñn]ala|indica|contempla|pide|exigen|dice|deben?\s+cumplir|debe))\b"
)
ENTITIES = (
    ("tabla", r"\btablas?\s+" + TABLE_ID),
    ("articulo", r"\bart[ií]culos?\s+" + TABLE_ID + r"[°ºo]?"),
    ("seccion", r"\bsecci[oó]n(?:es)?\s+(\d+(?:\.\d+)*)\b"),
    ("capitulo", r"\bcap[ií]tulos?\s+([ivxlcdm]+|\d+)\b"),
    ("anexo", r"\banexos?\s+([a-z0-9]+)\b"),
    ("norma", r"\b(ntc\s*\d+(?:-\d+)?|retie|retilap)\b"),
    ("ref", r"\b(\d{2,3}[.\-]\d{1,3}(?:[.\-]\d{1,3})?)\b"),
)
INTENTS = ("smalltalk", "puntual", "exhaustiva", "tabla", "comparativa", "procedimiento", "verificacion", "fuera_de_dominio")
FORMATS = ("markdown", "markdown_table", "bullet_list", "comparison", "steps")
LENGTHS = ("short", "medium", "detailed")
COMPLEXITIES = ("low", "medium", "high")
NUMBER = r"\d+(?:[.,]\d+)*"
LIST_MARKS = (r"(?<!\()\b([A-Za-z]{1,3}|\d{1,2})\)", r"\(([A-Za-z]{1,3}|\d{1,2})\)", r"(?m)^[ \t]*([A-Za-z]{1,3}|\d{1,2})\.(?=\s)")


def _has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit("(?iuU)" + pattern))


def is_smalltalk(text: Column) -> Column:
    return _has(collapse_elongations(text), rf"^\s*[¡¿]*\s*{GREETING}(?:[\s,.!?¡¿]+(?:y\s+)?{GREETING})*\s*[!.?¡¿]*\s*$")


def is_vague(text: Column) -> Column:
    """Nothing but function words and single characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    return F.size(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))) == 0


def rule_intent(text: Column) -> Column:
    return F.when(is_smalltalk(text), "smalltalk").when(_has(text, ASKS_TABLE), "tabla").when(_has(text, ASKS_COMPARISON), "comparativa").when(_has(text, ASKS_ALL), "exhaustiva").otherwise("puntual")


def classified(questions: DataFrame, question: str = "question", has_history: str | None = None, model_intent: str | None = None, model_confidence: str | None = None) -> DataFrame:
    """route, intent, source, wants_table and wants_full; a model's intent counts from 0.7, a sensitive one from 0.85, out of domain from 0.8 too."""
    text = F.col(question)
    history = F.col(has_history) if has_history else F.lit(False)
    rule = rule_intent(text)
    guess = F.col(model_intent) if model_intent else F.lit(None).cast("string")
    sure = F.col(model_confidence) if model_confidence else F.lit(None).cast("double")
    trusted = guess.isNotNull() & (sure >= F.when(guess.isin("fuera_de_dominio", "comparativa", "verificacion"), 0.85).otherwise(0.7)) & (guess != "smalltalk")
    intent = F.when(is_smalltalk(text), "smalltalk").when(is_vague(text) & ~history, "ambiguous").when(trusted, guess).when(rule == "smalltalk", "puntual").otherwise(rule)
    source = F.when(is_smalltalk(text) | (is_vague(text) & ~history), "regex").when(trusted, "model").otherwise("regex")
    done = questions.withColumns({"intent": intent, "decided_by": source})
    return done.withColumns({
        "route": F.when(F.col("intent").isin("smalltalk", "ambiguous"), F.col("intent")).when(F.col("intent") == "fuera_de_dominio", "out_of_domain").otherwise("retrieval"),
        "wants_table": F.col("intent") == "tabla",
        "wants_full": F.col("intent").isin("exhaustiva", "comparativa"),
    })


def _typed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))


def entities(text: Column) -> Column:
    """Distinct array of struct(type, value); a bare number only if no table, article or section has it."""
    found = []
    for kind, pattern in ENTITIES:
        values = F.regexp_extract_all(text, F.lit("(?iuU)" + pattern), F.lit(1))
        if kind == "norma":
            values = F.transform(values, lambda v: F.regexp_replace(F.upper(v), r"\s+", " "))
        elif kind in ("tabla", "articulo"):
            values = F.transform(values, lambda v: F.regexp_replace(v, r"\s+", ""))
        else:
            values = F.transform(values, lambda v: F.trim(v))  # as a bare function it would take the place in the array for the characters to trim
        if kind == "ref":
            values = F.array_except(values, F.transform(F.filter(F.concat(*found), lambda e: e["type"].isin("tabla", "articulo", "seccion")), lambda e: e["value"]))
        found.append(_typed(kind, F.array_distinct(values)))
    return F.concat(*found)


def fidelity_tokens(text: Column) -> Column:
    """Numbers (comma as dot) and list marks, sorted, with repeats: equal arrays mean that nothing was lost or invented."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda n: F.concat(F.lit("n:"), F.replace(n, F.lit(","), F.lit("."))))
    marks = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda m: F.concat(F.lit("l:"), F.lower(m))) for p in LIST_MARKS]
    return F.array_sort(F.concat(numbers, *marks))


def fidelity_diff(pairs: DataFrame, key: str, draft: str, candidate: str) -> DataFrame:
    """(key, token, missing, added): counts of tokens that one side has more often."""
    side = lambda c, name: pairs.select(key, F.explode(fidelity_tokens(F.col(c))).alias("token")).groupBy(key, "token").agg(F.count("*").alias(name))
    both = side(draft, "a").join(side(candidate, "b"), [key, "token"], "full").fillna(0, ["a", "b"])
    return both.where("a != b").select(key, "token", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("missing"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("added"))


def accepted(draft: Column, candidate: Column) -> Column:
    """struct(status, text): a rewrite counts if it has 20 characters and the draft's tokens."""
    status = F.when(candidate.isNull() | (F.length(F.trim(candidate)) < 20), "fallback").when(fidelity_tokens(draft) == fidelity_tokens(candidate), "ok").otherwise("rejected_fidelity")
    return F.struct(status.alias("status"), F.when(status == "ok", candidate).otherwise(draft).alias("text"))


def model_intent(raw: Column) -> Column:
    """A model's JSON answer checked: unknown intent is null, other fields fall back, confidence is clamped."""
    get = lambda f: F.get_json_object(raw, f"$.{f}")
    one_of = lambda f, allowed, other: F.when(get(f).isin(*allowed), get(f)).otherwise(other)
    sure = F.coalesce(F.try_to_number(get("confidence"), F.lit("S99D999")).cast("double"), get("confidence").try_cast("double"), F.lit(0.5))
    out = F.struct(
        get("intent").alias("intent"), one_of("response_format", FORMATS, "markdown").alias("response_format"), one_of("output_length", LENGTHS, "medium").alias("output_length"),
        one_of("complexity", COMPLEXITIES, "medium").alias("complexity"), F.coalesce(get("needs_calculation") == "true", F.lit(False)).alias("needs_calculation"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), sure)).alias("confidence"),
    )
    return F.when(get("intent").isin(*INTENTS), out)


def last_turns(messages: DataFrame, n: int, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n messages of each session with their place, oldest first."""
    last = messages.withColumn("_back", F.row_number().over(W.partitionBy(session).orderBy(F.col(turn).desc()))).where(F.col("_back") <= n)
    return last.withColumn("place", F.row_number().over(W.partitionBy(session).orderBy(turn))).drop("_back")


def history_text(messages: DataFrame, n: int = 6, cut: int = 500, session: str = "conv_id") -> DataFrame:
    """(session, history): the last n non-empty messages as ``role: text`` lines, long ones cut."""
    kept = last_turns(messages.where(F.trim("text") != ""), n, session)
    body = F.when(F.length("text") > cut, F.concat(F.substring("text", 1, cut), F.lit("…"))).otherwise(F.col("text"))
    line = F.concat(F.col("role"), F.lit(": "), body)
    return kept.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))


def citations(hits: DataFrame, limit: int = 5, query: str = "query_id") -> DataFrame:
    """(query, place, line) of the first distinct (source, page) of each query."""
    from folioscope.functions.text import first_section, source_name

    named = hits.withColumns({"source": source_name(F.col("source")), "section": first_section(F.col("text"))})
    first = named.groupBy(query, "source", "page").agg(F.min(F.struct("ord", "section")).alias("f"))
    placed = first.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy("f.ord"))).where(F.col("place") <= limit)
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit("pág. "), F.col("page").cast("string")))
    return placed.select(query, "place", F.concat(F.col("place").cast("string"), F.lit(". "), F.concat_ws(" · ", "source", page, "f.section")).alias("line"))


def source_flags(flag: Column) -> Column:
    """struct(index, notebook, files, primary) that a source setting switches on; an unknown one means index and notebook."""
    f = F.lower(F.regexp_replace(F.trim(flag), "^[\"']+|[\"']+$", ""))
    row = lambda i, n, g, p: F.struct(F.lit(i).alias("index"), F.lit(n).alias("notebook"), F.lit(g).alias("files"), F.lit(p).alias("primary"))
    return F.when(f.isin("chroma", "index"), row(True, False, False, "index")).when(f.isin("notebooklm", "nlm"), row(False, True, False, "notebook")).when(f == "gemini", row(False, False, True, "files")).otherwise(row(True, True, False, "notebook"))


def resolved_rules(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """asked (id, intent, format) with the rule for (intent, format), else (intent, any), else (any, format), else the default."""
    both = rules.select("intent", "format", F.col("name").alias("_a"))
    by_intent = rules.where("format IS NULL AND intent IS NOT NULL").select("intent", F.col("name").alias("_b"))
    by_format = rules.where("intent IS NULL AND format IS NOT NULL").select("format", F.col("name").alias("_c"))
    return asked.join(both, ["intent", "format"], "left").join(by_intent, "intent", "left").join(by_format, "format", "left").select("id", F.coalesce("_a", "_b", "_c", F.lit("default")).alias("rule"))
