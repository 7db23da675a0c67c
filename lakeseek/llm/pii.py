"""Personal data by candidate gradient boosting, in DataFrame and SQL functions alone.

Generators with loose patterns propose spans of four kinds, which may overlap. A candidate that is
a match of its kind's strict pattern, place for place, takes its label from the strict check. One that overlaps
such matches without being one (a card number within a longer row of digits) has no label and no weight: the trees alone
judge it. One that meets none is a weak negative (``WEAK`` of a row's weight). Boosted trees learn from features
of format (digits, separators, a checksum or ending of the candidate itself) and context (words before it, what it
is glued to) on three quarters of the texts, dealt by hash; the other quarter calibrates, per kind, the least margin that reaches
``PRECISION``. Strict spans always stay; candidates at or above the threshold that overlap no
chosen span are added.

Spans come from splitting a text at the pattern: the lengths of the pieces and matches add up to
positions in code points. Patterns use possessive repeats and look-behinds, so no long run is
scanned twice and none deepens Java's stack.

Defined cases: a null text is empty and has no spans; a table without candidates, or without any held-out match of a kind, adds none;
repeated rows come out as often as they go in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.llm import boosting
from lakeseek.llm.common import read_table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
STRICT = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++(?:@| ?[\[(]at[\])] ?)[\p{L}0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[\p{L}0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3,}+",
    "card": r"(?<![0-9])[0-9](?:[ .-]?[0-9])++",
    "card_run": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ .-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9+])[+(]?[0-9](?:[ ().-]{0,2}[0-9])++",
}
CUES = {
    "email": "mail|contact|kontakt|correo|courriel|write to",
    "ip": r"\bip\b|host|server|address|adresse",
    "card": "card|visa|karte|carte|tarjeta|credit",
    "phone": r"phone|\btel|call|fax|mobil|telefon|appel",
}
#: The kind each generator proposes.
GENERATORS = {"email": "email", "ip": "ip", "card": "card", "card_run": "card", "phone": "phone"}
FEATURES = ["kind", "digits", "marked", "style", "form", "cue", "other_cue", "glued"]
RANGES = [3, 7, 1, 2, 1, 1, 1, 1]
WEAK, PRECISION, ROUNDS, FOLDS = 0.25, 0.98, 20, 4
BLOCK = 256


def located(docs: DataFrame, name: str, text: Column, pattern: str, when: Column) -> DataFrame:
    """``docs`` with a column ``name``: array<struct<start,end,hit,before,after>> of the pattern's matches.

    Lengths are summed block by block, so that a text with n matches costs about n * BLOCK steps.
    """
    p, m, n, o, e = (f"{name}_{k}" for k in "pmnoe")
    return (
        docs.withColumn(p, F.when(when, F.split(text, pattern, -1)))
        .withColumn(m, F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
        .withColumn(n, F.expr(f"transform({m}, (x, i) -> char_length({p}[i]) + char_length(x))"))
        .withColumn(o, F.expr(f"""aggregate(
            transform(sequence(0, (size({n}) - 1) div {BLOCK}), b -> aggregate(slice({n}, int(b * {BLOCK} + 1), {BLOCK}), 0, (a, x) -> a + x)),
            array(0), (a, x) -> concat(a, array(a[size(a) - 1] + x)))"""))
        .withColumn(e, F.expr(f"""flatten(transform(sequence(0, (size({n}) - 1) div {BLOCK}), b -> aggregate(
            slice({n}, int(b * {BLOCK} + 1), {BLOCK}), cast(array() as array<int>),
            (a, x) -> concat(a, array(if(size(a) = 0, {o}[int(b)], a[size(a) - 1]) + x)))))"""))
        .withColumn(name, F.expr(f"""transform({m}, (x, i) -> struct({e}[i] - char_length(x) as start, {e}[i] as end, x as hit,
            right({p}[i], 24) as before, left({p}[i + 1], 1) as after))"""))
        .drop(p, m, n, o, e)
    )


def _digits(hit: str) -> str:
    return f"regexp_replace({hit}, '[^0-9]', '')"


def _luhn(hit: str) -> str:
    d = _digits(hit)
    double = f"2 * int(substr({d}, -i, 1))"
    return f"(aggregate(sequence(1, char_length({d})), 0, (a, i) -> a + if(i % 2 = 1, int(substr({d}, -i, 1)), {double} - if({double} > 9, 9, 0))) % 10 = 0)"


def _checks(hit: str) -> dict[str, str]:
    octet = "trim(LEADING '0' FROM q)"
    return {
        "email": "true",
        "ip": f"forall(split({hit}, '[.]'), q -> char_length({octet}) <= 3 AND coalesce(try_cast({octet} as int), 0) <= 255)",
        "card": f"(CASE WHEN char_length({_digits(hit)}) BETWEEN 16 AND 19 THEN {_luhn(hit)} ELSE false END)",
        "phone": f"char_length({_digits(hit)}) BETWEEN 8 AND 15",
    }


def _described(generator: str) -> str:
    """SQL of a generator's candidates with their features; label 1, 0, -1 (overlaps strict matches, is none) or null (meets none)."""
    kind = GENERATORS[generator]
    code, d = KINDS.index(kind), _digits("c.hit")
    count = f"char_length({d})"
    others = "|".join(v for k, v in CUES.items() if k != kind)
    forms = {
        "email": "c.hit rlike '[A-Za-z]{2,}$'", "ip": _checks("c.hit")["ip"], "phone": "c.hit rlike '[0-9]{3}[ .-]?[0-9]{4}$'",
        "card": f"(CASE WHEN {count} BETWEEN 12 AND 19 THEN {_luhn('c.hit')} ELSE false END)",
    }
    cue = lambda p: p.replace("\\", "\\\\")
    return f"""transform(loose_{generator}, c -> named_struct('kind', {code}, 'start', c.start, 'end', c.end,
        'digits', CASE WHEN {count} = 0 THEN 0 WHEN {count} < 8 THEN 1 WHEN {count} < 10 THEN 2 WHEN {count} < 12 THEN 3
                       WHEN {count} < 13 THEN 4 WHEN {count} < 16 THEN 5 WHEN {count} < 20 THEN 6 ELSE 7 END,
        'marked', int(c.hit rlike '[+@]'),
        'style', least(2, size(array_distinct(regexp_extract_all(c.hit, '[ ().-]', 0)))),
        'form', int({forms[kind]}),
        'cue', int(lower(c.before) rlike '{cue(CUES[kind])}'), 'other_cue', int(lower(c.before) rlike '{cue(others)}'),
        'glued', int(c.after rlike '[\\\\p{{L}}0-9_]'),
        'label', CASE WHEN exists(strict_{kind}, s -> s.start = c.start AND s.end = c.end) THEN int(exists({kind}, s -> s.start = c.start AND s.end = c.end))
                      WHEN exists(strict_{kind}, s -> s.start < c.end AND c.start < s.end) THEN -1 END))"""


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (its columns boxed as ``row``) with the strict spans by kind and the described candidates."""
    body = F.coalesce(F.col("body"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    digits = F.col("body").rlike("[0-9]")
    near = {
        "email": F.contains(body, F.lit("@")),
        "ip": digits & F.col("body").rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": digits & F.col("body").rlike(r"[0-9](?:[ -]?[0-9]){15}"),
        "phone": F.contains(body, F.lit("+")) & digits,
    }
    wide = {
        "email": F.contains(body, F.lit("@")) | F.contains(body, F.lit("at]")) | F.contains(body, F.lit("at)")),
        "ip": near["ip"],
        "card": digits & F.col("body").rlike(r"[0-9](?:[ .-]?[0-9]){12}"),
        "card_run": digits & F.col("body").rlike(r"[0-9](?:[ .-]?[0-9]){12}"),
        "phone": digits & F.col("body").rlike(r"[0-9](?:[ ().-]{0,2}[0-9]){6}"),
    }
    for kind in KINDS:
        rows = located(rows, f"strict_{kind}", body, STRICT[kind], near[kind])
    for generator in GENERATORS:
        rows = located(rows, f"loose_{generator}", body, LOOSE[generator], wide[generator])
    none = "cast(array() as array<struct<start:int,end:int,hit:string,before:string,after:string>>)"
    for kind in KINDS:
        rows = rows.withColumn(f"strict_{kind}", F.expr(f"coalesce(strict_{kind}, {none})"))
        rows = rows.withColumn(kind, F.expr(f"filter(strict_{kind}, s -> {_checks('s.hit')[kind]})"))
    for generator, kind in GENERATORS.items():
        rows = rows.withColumn(f"loose_{generator}", F.expr(f"filter(coalesce(loose_{generator}, {none}), c -> {'true' if kind in ('email', 'ip') else 'char_length(' + _digits('c.hit') + ') >= 7'})"))
    found = rows.withColumn("candidates", F.expr("concat(" + ", ".join(_described(g) for g in GENERATORS) + ")"))
    return found.select("row", "body", *KINDS, "candidates")


def train(found: DataFrame) -> tuple[list, dict[str, float]]:
    """Trees and thresholds from the candidates of ``with_candidates``; at most a few thousand distinct vectors are collected."""
    # explode_outer: a filter on the array's size would be pushed down and its expressions repeated at every step
    held = F.pmod(F.xxhash64("body"), F.lit(FOLDS)) == 0
    seen = found.select(held.alias("held"), F.explode_outer("candidates").alias("c")).groupBy("held", *[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(
        F.count(F.when(F.col("c.label") == 1, 1)).alias("one"),
        F.count(F.when(F.col("c.label") == 0, 1)).alias("zero"),
        F.count(F.when(F.col("c.label").isNull(), 1)).alias("unknown"),
    )
    table = sorted((r["held"], tuple(r[f] for f in FEATURES), float(r["one"]), r["zero"] + WEAK * r["unknown"]) for r in seen.collect() if r["kind"] is not None)
    trees = boosting.fit([t[1:] for t in table if not t[0]], RANGES, ROUNDS)
    return trees, {k: boosting.threshold(trees, [t[1:] for t in table if t[0] and t[1][0] == i], PRECISION) for i, k in enumerate(KINDS)}


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (struct of the columns of ``docs``), body, strict spans by kind, and ``spans`` by kind, then start."""
    found = with_candidates(docs, text)
    trees, least = train(found)
    margin = boosting.as_sql(trees, [f"c.{f}" for f in FEATURES])
    enough = " OR ".join(f"(c.kind = {i} AND ({margin}) >= {least[k]!r}D)" for i, k in enumerate(KINDS) if least[k] != float("inf")) or "false"
    strict = "concat(" + ", ".join(f"transform({k}, s -> struct({i} as kind, s.start, s.end))" for i, k in enumerate(KINDS)) + ")"
    return (
        found.withColumn("base", F.expr(strict))
        .withColumn("chosen", F.expr(f"filter(candidates, c -> NOT exists(base, s -> s.start < c.end AND c.start < s.end) AND ({enough}))"))
        .withColumn("chosen", F.expr("filter(chosen, (c, i) -> NOT exists(slice(chosen, 1, i), s -> s.start < c.end AND c.start < s.end))"))
        .withColumn("spans", F.expr("array_sort(concat(base, transform(chosen, c -> struct(c.kind as kind, c.start, c.end))))"))
        .select("row", "body", *KINDS, "base", "spans")
    )


def _text(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({', '.join(map(repr, KINDS))}), s.kind + 1), s.start, s.end)), ',')"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.expr(f"sha2(cast({_text('base')} as binary), 256)").alias("base_sha256"), F.expr(_text("spans")).alias("spans"),
    )


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; of overlapping spans the first names the gap."""
    found = with_spans(docs, text)
    fold = f"""aggregate(array_sort(transform(spans, s -> struct(s.start as start, -s.end as upto, s.kind as kind))), struct(0 as at, '' as done),
        (a, s) -> struct(greatest(a.at, -s.upto) as at,
            CASE WHEN s.start >= a.at THEN concat(a.done, substr(body, a.at + 1, s.start - a.at), '[', upper(element_at(array({', '.join(map(repr, KINDS))}), s.kind + 1)), ']') ELSE a.done END as done),
        a -> concat(a.done, substr(body, a.at + 1)))"""
    new = F.when(F.size("spans") > 0, F.expr(fold)).otherwise(F.col("row").getField(text))
    return found.select(*[new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
