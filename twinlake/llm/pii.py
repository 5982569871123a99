"""Personal data: patterns propose, checksums confirm, context words adjust. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.llm.common import let, others, unused

#: Fixed values of the contract's four base kinds, in its order, then this operator's own kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")

#: Linear-time forms (possessive or lazy, no repeated groups, so no deep recursion) of the patterns that
#: the kinds are defined by. A start inside a run of its own class is excluded, for there the run's
#: start would have matched; \G admits what follows a match at once.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])[A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|(?![A-Za-z0-9.-]))",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?=[ -]?[0-9])[0-9 -]*?(?=[ -](?![0-9])|(?![0-9 -]))",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score of a confirmed span without context, and words near it that raise the score.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "secret": 0.4}
CONTEXT_WORDS = {
    "email": r"(?i)\b(e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(ip|host|server|address|login)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|payment|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax|telefon|teléfono|téléphone)\b",
    "iban": r"(?i)\b(iban|account|bank|konto|cuenta|compte)\b",
    "ssn": r"(?i)\b(ssn|social|security)\b",
    "secret": r"(?i)\b(key|token|secret|password|api)\b",
}
#: Spans of the own kinds need this score; base kinds need only their checksum.
THRESHOLD = 0.5
CONTEXT_CHARS = 40
RAISE = 0.3

_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Luhn's sum over a string of digits, from the right."""
    n = F.length(d)

    def one(i):
        x = F.substr(d, n - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return F.when(i % 2 == 1, twice).otherwise(x)

    return F.reduce(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + one(i)) % 10 == 0


def _mod97(m: Column) -> Column:
    """ISO 7064 mod 97-10 of an IBAN: the first four characters last, letters as 10 to 35, remainder 1."""
    def rest(turned):
        def step(r, i):
            c = F.ascii(F.substr(turned, i, F.lit(1)))
            return F.when(c >= 65, (r * 100 + c - 55) % 97).otherwise((r * 10 + c - 48) % 97)

        return F.length(turned).between(15, 34) & (F.reduce(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1)

    s = F.translate(m, " ", "")
    return let(F.concat(F.substr(s, F.lit(5)), F.left(s, F.lit(4))), rest)


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return _mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


#: Values that ``running`` folds one by one; a power of two.
BLOCK_BITS = 6


def running(values: Column, zero: Column, merge) -> Column:
    """For each value the fold of all before it: by blocks, so the work is a few dozen steps a value however many there are."""
    block = 1 << BLOCK_BITS

    def by_blocks(v):
        last = F.shiftright(F.size(v) - 1, BLOCK_BITS)
        whole = F.transform(F.sequence(F.lit(0), last), lambda b: F.reduce(F.slice(v, b * block + 1, F.lit(block)), zero, merge))
        first = let(whole, lambda w: F.transform(w, lambda _, b: F.reduce(F.slice(w, F.lit(1), b), zero, merge)))
        one = lambda f: F.transform(v, lambda _, j: F.reduce(F.slice(v, j - j % block + 1, j % block), F.get(f, F.shiftright(j, BLOCK_BITS)), merge))
        return F.when(F.size(v) > 0, let(first, one)).otherwise(F.array().cast("array<int>"))

    return let(values, by_blocks)


def _found(text: Column, kind: str) -> Column:
    """Confirmed matches of one kind with their places in code points.

    The pieces between matches and the matches give the places: their lengths add up. They also give each match its
    surroundings, of which no more than ``CONTEXT_CHARS`` pieces are needed; so no match looks at the whole text."""
    none = F.lit(None).cast(_SPAN)
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    parts = F.flatten(F.transform(F.arrays_zip(hits.alias("m"), gaps.alias("g")), lambda x: F.array(x.g, F.coalesce(x.m, F.lit("")))))
    near = lambda s: s.rlike(CONTEXT_WORDS[kind])
    score = lambda b, a: F.least(F.lit(1.0), F.when(near(b) | near(a), BASE_SCORE[kind] + RAISE).otherwise(BASE_SCORE[kind]))

    def placed(p):
        def spans(at):
            def one(m, j):
                own = 2 * j + 1  # of the match among the parts, the piece before it being 2 j
                some = F.least(own, F.lit(CONTEXT_CHARS))
                before = F.right(F.array_join(F.transform(F.slice(p, own - some + 1, some), lambda x: F.right(x, F.lit(CONTEXT_CHARS))), ""), F.lit(CONTEXT_CHARS))
                after = F.left(F.array_join(F.transform(F.slice(p, own + 2, F.lit(CONTEXT_CHARS)), lambda x: F.left(x, F.lit(CONTEXT_CHARS))), ""), F.lit(CONTEXT_CHARS))
                start = F.get(at, own)
                return F.struct(m.alias("m"), start.alias("start"), (start + F.length(m)).alias("end"), score(before, after).alias("score"))

            return F.transform(hits, one)

        return let(running(F.transform(p, F.length), F.lit(0), lambda a, n: a + n), spans)

    spans = F.filter(let(parts, placed), lambda s: _confirmed(kind, s.m))
    spans = F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.score.alias("score")))
    if kind not in KINDS[:4]:
        spans = F.filter(spans, lambda s: s.score >= THRESHOLD)
    has = text.rlike(PATTERNS[kind])
    if kind in NEEDS:
        has = F.contains(text, F.lit(NEEDS[kind])) & has
    return F.when(has, spans).otherwise(none)


def find_pii(df: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = KINDS, out: str = "_spans") -> DataFrame:
    """All columns and ``out``: array of (kind, start, end, score) by start, then kind as listed.

    A column of the input that is named like ``out`` is replaced.

    Places are code points, the end exclusive. Matches of a kind are leftmost and do not overlap; a
    match that its validator refuses is dropped without a retry. E-mail, IP, card and phone spans stay
    whatever their score; IBAN, SSN and secret spans need ``THRESHOLD``, which context words in the
    ``CONTEXT_CHARS`` characters before or after them can lift them to. Null and empty texts have no spans.
    Rows are taken one by one: repeated rows and null ids are of no matter. The work is linear in a text's
    length and in its matches."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rank = {k: i for i, k in enumerate(kinds)}
    empty = F.array().cast(_SPAN)
    raw = unused(df, "_found")
    every = df.withColumn(raw, F.flatten(F.array(*[F.coalesce(_found(text, k), empty) for k in kinds])))
    order = F.create_map(*[F.lit(x) for k in kinds for x in (k, rank[k])])
    less = F.array_sort(F.transform(raw, lambda s: F.struct(s.start.alias("start"), order[s.kind].alias("k"), s.end.alias("end"), s.kind.alias("kind"), s.score.alias("score"))))
    spans = F.transform(less, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.score.alias("score")))
    return every.select(*[F.col(f"`{c}`") for c in others(df, out)], spans.alias(out))


def redact(df: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The same columns, each span in ``text_col`` replaced by its kind in angle brackets.

    Of overlapping spans the first by start stays whole and what a later one adds is cut too. Null stays null."""
    spans = unused(df, "_spans")
    found = find_pii(df, text_col, kinds, spans)
    text = F.col(f"`{text_col}`")
    covered = running(F.transform(spans, lambda x: x.end), F.lit(0), lambda a, e: F.greatest(a, e))
    letters = lambda c, a, z: F.array_join(F.slice(c, a + 1, z - a), "")

    def masked(c):
        def said(to):
            one = lambda x, j: let(F.get(to, j), lambda at: F.when(x.start >= at, F.concat(letters(c, at, x.start), F.lit("<"), F.upper(x.kind), F.lit(">"))).otherwise(F.lit("")))
            return F.array_join(F.transform(spans, one), "")

        end = F.array_max(F.transform(spans, lambda x: x.end))
        return F.concat(let(covered, said), letters(c, end, F.size(c)))

    new = F.when(F.size(spans) > 0, let(F.split(text, ""), masked)).otherwise(text)
    return found.select(*[(new if c == text_col else F.col(f"`{c}`")).alias(c) for c in df.columns])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op8(spark, sf_dir: str) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = find_pii(docs)
    count = lambda k: F.size(F.filter("_spans", lambda s: s.kind == k)).cast("long")
    base = F.filter("_spans", lambda s: s.kind.isin(*KINDS[:4]))
    return d.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"))
