"""Personal data: fixed patterns, and bootstrapped contexts that find identifiers the patterns miss.

Everything runs as DataFrame expressions. A pattern's matches are set between
separator characters by one ``regexp_replace``, the text is split there, and the
lengths of the pieces give code-point positions. All quantifiers that can be are
possessive and every pattern starts only where a run of its characters starts
(or the match before ended), so no text makes the matcher go back over a run.

The bootstrap: found entities are seeds. What stands before and after an
identifier-like token (two words, one word, next word) is its set of contexts.
Every single token outside base spans is a candidate, and so is every run of
neighbouring ones that has a shape; of hits that overlap, the longest from the
left stays. A
context's confidence in a kind is the summed score of its different instances
over their number; an instance scores 1 if it is a seed, else the best
confidence among its contexts. Both are recomputed ``ROUNDS`` times over the
context-instance graph. Tokens of a kind's shape in a context of at least
``CONFIDENT`` that ``SUPPORT`` different seeds back are found by the method.

Defined cases: null and empty texts have no spans. Every row gives one row; rows
with equal id and text get equal spans. Rows with a null id are told apart by
their text's hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import common
from vitalgrid.operators.ordering import by_shuffle

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 3
CONFIDENT = 0.75
#: Characters of text on either side in which a context is looked for.
NEAR = 80

_SEP, _STAND_IN = "\ue000", "\ue001"
#: Stand around base spans while candidates are looked for.
_OPEN, _CLOSE = "\ue002", "\ue003"

#: The four kinds' patterns, with possessive quantifiers where nothing after them could take a character back.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Base spans, and between them tokens with a digit or an at sign: what may be (part of) an identifier.
_TOKEN = rf"{_OPEN}[^{_CLOSE}]*+{_CLOSE}|(?<![^\s{_CLOSE}])[^\s0-9@{_OPEN}]*+[0-9@][^\s{_OPEN}]*+"
#: Tokens that a run with a shape has at most: one for each digit of the longest card number.
LONGEST = 19
_CHUNK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _plain(docs_text: Column) -> Column:
    """The text without the characters that serve as marks here."""
    return F.translate(F.coalesce(docs_text.cast("string"), F.lit("")), _SEP + _OPEN + _CLOSE, _STAND_IN * 3)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_part(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small_part)
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


#: A text without this cannot match; cheaper than the pattern.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def _matches(text: Column, pattern: str, needs: str | None) -> Column:
    """array<struct<start, value, gap, before, after>> of all matches; starts count code points from 0.

    ``gap`` is what stands between a match and the one before it. Marks around base spans count for nothing.
    """
    marked = F.regexp_replace(text, pattern, f"{_SEP}$0{_SEP}")
    if needs:
        marked = F.when(F.contains(text, F.lit(needs)), marked).otherwise(F.lit(""))

    # pieces are taken in chunks: an array that grows piece by piece is copied at every step
    def chunk(c: Column, pieces: Column) -> Column:
        return F.slice(pieces, c * _CHUNK + 1, F.lit(_CHUNK))

    def starts(pieces: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("starts"))
        return F.aggregate(
            pieces, begin,
            lambda a, p: F.struct(
                (a["at"] + F.length(p) - F.when(p.startswith(_OPEN), 2).otherwise(0)).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")
            ),
        )

    def located(pieces: Column) -> Column:
        chunks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _CHUNK).cast("int")),
            lambda c: starts(chunk(c, pieces), F.lit(0).cast("bigint")),
        )
        begin = F.struct(
            F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("all")
        )
        moved = F.aggregate(
            chunks, begin,
            lambda a, c: F.struct(
                (a["at"] + c["at"]).alias("at"),
                F.array_append(a["all"], F.transform(c["starts"], lambda s: s + a["at"])).alias("all"),
            ),
            lambda a: F.flatten(a["all"]),
        )
        each = F.arrays_zip(moved.alias("start"), pieces.alias("value"))
        # two words before and one after may lie beyond neighbouring matches
        return F.filter(
            F.transform(
                each,
                lambda m, i: F.when(
                    i % 2 == 1,
                    F.struct(
                        m["start"].alias("start"), m["value"].alias("value"), F.get(pieces, i - 1).alias("gap"),
                        F.right(F.concat(*[F.right(piece(pieces, i - k), F.lit(NEAR)) for k in (4, 3, 2, 1)]), F.lit(NEAR)).alias("before"),
                        F.left(F.concat(*[F.left(piece(pieces, i + k), F.lit(NEAR)) for k in (1, 2)]), F.lit(NEAR)).alias("after"),
                    ),
                ),
            ),
            lambda m: m.isNotNull() & m["start"].isNotNull(),
        )

    def piece(pieces: Column, at: Column) -> Column:
        return F.translate(F.coalesce(F.get(pieces, at), F.lit("")), _OPEN + _CLOSE, "")

    none = F.array().cast("array<struct<start:bigint,value:string,gap:string,before:string,after:string>>")
    return _let(F.split(marked, _SEP), lambda parts: F.when(F.size(parts) > 1, located(parts)).otherwise(none))


def _words(text: Column) -> Column:
    """The words of a short stretch of text, digits alike and in lower case."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, "[0-9]", "0")), r"\s+"), lambda w: w != "")


def _contexts(before: Column, after: Column) -> Column:
    left, right = _words(before), _words(after)
    one, two, next_ = F.element_at(left, -1), F.try_element_at(left, F.lit(-2)), F.element_at(right, 1)
    made = F.array(
        F.when(F.size(left) > 1, F.concat(F.lit("L2 "), two, F.lit(" "), one)),
        F.when(F.size(left) > 0, F.concat(F.lit("L1 "), F.try_element_at(left, F.lit(-1)))),
        F.when(F.size(right) > 0, F.concat(F.lit("R1 "), F.try_element_at(right, F.lit(1)))),
    )
    return F.filter(made, lambda c: c.isNotNull())


def _marked(text: Column, base: Column) -> Column:
    """The text with marks around what base spans cover."""
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def stretch(start: Column, end: Column) -> Column:
        return F.substring(text, start.cast("int") + 1, (end - start).cast("int"))

    cut = F.aggregate(
        base, begin,
        lambda a, s: F.when(s["end"] <= a["at"], F.struct(a["at"].alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(a["out"], F.array(
                    stretch(a["at"], F.greatest(s["start"], a["at"])), F.lit(_OPEN),
                    stretch(F.greatest(s["start"], a["at"]), s["end"]), F.lit(_CLOSE),
                )).alias("out"),
            )
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"].cast("int") + 1, F.length(text) + 1)),
    )
    return F.when(F.size(base) > 0, cut).otherwise(text)


def _bare(m: Column) -> Column:
    """The token without quotes, brackets and commas around it; a bracket around leading digits belongs to it."""
    lead = F.length(F.regexp_extract(m["value"], r"^(?:[\"'\[{<,;:|/=]|\((?![0-9]+\)))*", 0))
    rest = F.substring(m["value"], lead + 1, F.length(m["value"]))
    return F.struct(
        (m["start"] + lead).alias("start"), F.rtrim(rest, F.lit("\"'}]>).,;:!?*#$%&|")).alias("value"),
        m["before"].alias("before"), m["after"].alias("after"), m["left"].alias("left"), m["right"].alias("right"), m["stays"].alias("stays"),
    )


def _candidates(matches: Column) -> Column:
    """Single tokens, whole runs of tokens one space apart, and parts of runs that have a shape.

    ``left`` and ``right``: the candidate counts among the instances of its contexts on that side. At
    the ends of a run that is the whole run, inside it each token; parts of runs are not counted.
    """
    def is_base(m: Column) -> Column:
        return m["value"].startswith(_OPEN)

    def made(tokens: Column, glued: Column) -> Column:
        def inside(at: Column) -> Column:
            return F.coalesce(F.get(glued, at), F.lit(False))

        def runs(m: Column, i: Column) -> Column:
            rest = F.slice(glued, i + 2, LONGEST - 1)
            stop = F.array_position(rest, False).cast("int")
            reach = F.when(stop == 0, F.size(rest)).otherwise(stop - 1)
            late = F.when(i >= LONGEST - 1, ~F.array_contains(F.slice(glued, F.greatest(i - LONGEST + 3, F.lit(1)), LONGEST - 1), False)).otherwise(False)

            def run(k: Column) -> Column:
                whole = ~inside(i) & ~inside(i + k + 1)
                return F.struct(
                    m["start"].alias("start"),
                    F.when(k == 0, m["value"]).otherwise(F.array_join(F.transform(F.slice(tokens, i + 1, k + 1), lambda t: t["value"]), " ")).alias("value"),
                    m["before"].alias("before"), F.get(tokens, i + k)["after"].alias("after"),
                    (whole | ((k == 0) & (inside(i) | (reach == LONGEST - 1)))).alias("left"),
                    (whole | ((k == 0) & (inside(i + 1) | late))).alias("right"),
                    (whole | (k == 0)).alias("stays"),
                )

            return F.when(is_base(m), F.array()).otherwise(F.transform(F.sequence(F.lit(0), reach), run))

        return F.flatten(F.transform(tokens, runs))

    def glue(tokens: Column) -> Column:
        return F.transform(
            tokens, lambda m, i: (m["gap"] == " ") & ~is_base(m) & ~F.coalesce(is_base(F.get(tokens, i - 1)), F.lit(True))
        )

    all_ = _let(matches, lambda tokens: _let(glue(tokens), lambda glued: made(tokens, glued)))
    kept = F.filter(F.transform(all_, _bare), lambda c: c["stays"] | (F.size(_shapes(c["value"])) > 0))
    return F.transform(
        kept,
        lambda c: F.struct(
            c["start"].alias("start"), c["value"].alias("value"), _contexts(c["before"], c["after"]).alias("contexts"),
            c["left"].alias("left"), c["right"].alias("right"),
        ),
    )


def found(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, key, base`` spans by start and kind, and ``others``: identifier-like tokens elsewhere."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _plain(F.col("text")).alias("_t"))
    sized = rows.select(
        "doc_id", "_t", F.xxhash64("_t").alias("key"),
        *[_matches(F.col("_t"), p, _NEEDS.get(k)).alias(f"_{k}") for k, p in _PATTERNS.items()],
    )

    def spans(kind: str, no: int) -> Column:
        good = F.filter(f"_{kind}", lambda m: _valid(kind, m["value"]))
        return F.transform(
            good,
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(no).alias("no"), (m["start"] + F.length(m["value"])).alias("end"),
                F.lit(kind).alias("kind"), m["value"].alias("value"), _contexts(m["before"], m["after"]).alias("contexts"),
            ),
        )

    based = sized.withColumn("base", F.array_sort(F.concat(*[spans(k, i) for i, k in enumerate(KINDS)])))
    marked = based.select("doc_id", "key", "base", _marked(F.col("_t"), F.col("base")).alias("_m"))
    return marked.select("doc_id", "key", "base", _candidates(_matches(F.col("_m"), _TOKEN, None)).alias("others"))


def _shapes(value: Column) -> Column:
    """Kinds whose shape a token has, more loosely than their patterns."""
    n = F.length(_digits(value))
    return F.filter(
        F.array(
            F.when(value.rlike(r"^[^@\s]+@[^@\s]+$"), F.lit("email")),
            F.when(value.rlike(r"^[0-9a-fA-F:.]+$") & value.rlike(r"[.:].*[.:]") & n.between(4, 39), F.lit("ip")),
            F.when(value.rlike(r"^[0-9 -]+$") & n.between(12, 19), F.lit("card")),
            F.when(value.rlike(r"^[(]?[0-9][0-9 ().-]+$") & n.between(7, 15), F.lit("phone")),
        ),
        lambda k: k.isNotNull(),
    )


def bootstrapped(rows: DataFrame) -> DataFrame:
    """``doc_id, key, start, end, kind`` of tokens that high-confidence contexts point to."""
    named = rows.filter("size(base) > 0 OR size(others) > 0")
    seeds = named.select(F.explode("base").alias("s")).select("s.kind", "s.value", "s.contexts")
    tokens = named.select("doc_id", "key", F.explode("others").alias("o")).select(
        "doc_id", "key", "o.start", "o.value", "o.contexts", "o.left", "o.right", _shapes(F.col("o.value")).alias("kinds")
    )
    tokens = common.stored(tokens)
    sides = tokens.select("value", F.explode("contexts").alias("context"), "left", "right").select(
        "value", "context", F.when(F.col("context").startswith("L"), F.col("left")).otherwise(F.col("right")).alias("counted")
    )
    edges = common.stored(
        seeds.select("value", F.explode("contexts").alias("context"), F.lit(True).alias("counted"))
        .union(sides).groupBy("value", "context").agg(F.max("counted").alias("counted"))
    )
    counted = edges.filter("counted")
    totals = counted.groupBy("context").agg(F.count("*").alias("n"))
    sure = common.stored(seeds.select("kind", "value").distinct().withColumn("score", F.lit(1.0)))
    shaped = common.stored(
        tokens.select("value", F.explode("kinds").alias("kind")).distinct()
        .join(by_shuffle(sure), ["kind", "value"], "left_anti")
    )
    scores = sure
    for _ in range(ROUNDS):
        strength = common.stored(
            counted.join(by_shuffle(scores), "value")
            .groupBy("context", "kind")
            .agg(F.sum("score").alias("s"), F.sum((F.col("score") == 1.0).cast("int")).alias("seeds"))
            .filter(F.col("seeds") >= SUPPORT)
            .join(by_shuffle(totals), "context")
            .select("context", "kind", (F.col("s") / (F.col("n") + 1)).alias("confidence"))
        )
        spread = (
            shaped.join(by_shuffle(edges), "value").join(by_shuffle(strength), ["context", "kind"])
            .groupBy("kind", "value").agg(F.max("confidence").alias("score"))
        )
        scores = sure.unionByName(spread)
    sharp = strength.filter(F.col("confidence") >= CONFIDENT)
    hits = (
        tokens.filter("size(kinds) > 0").select("*", F.explode("contexts").alias("context"))
        .join(by_shuffle(sharp), "context")
        .filter(F.array_contains("kinds", F.col("kind")))
        .groupBy("doc_id", "key", "start", "value")
        .agg(F.max(F.struct("confidence", "kind"))["kind"].alias("kind"))
    )
    return hits.select("doc_id", "key", "start", (F.col("start") + F.length("value")).alias("end"), "kind")


def _written(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


_HITS = "array<struct<start:bigint,back:bigint,no1:int,end:bigint,kind:string>>"


def _longest(hits: Column) -> Column:
    """Hits that do not overlap: the longest from the left."""
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_HITS).alias("out"))
    return F.aggregate(
        F.array_sort(hits), begin,
        lambda a, s: F.when(s["start"] < a["at"], F.struct(a["at"].alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.array_append(a["out"], s).alias("out"))
        ),
        lambda a: a["out"],
    )


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, key, base, all``: spans as array<struct<start, no, end, kind>> by start, then kind."""
    rows = common.stored(found(docs))
    hits = F.struct(
        "start", (-F.col("end")).alias("back"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("no1"), "end", "kind"
    )
    more = bootstrapped(rows).groupBy("doc_id", "key").agg(F.collect_set(hits).alias("more"))
    more = more.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), _longest(F.col("more")).alias("more"))
    plain = F.transform(
        "base", lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    added = F.transform(
        F.coalesce("more", F.array().cast(_HITS)),
        lambda s: F.struct(s["start"].alias("start"), (s["no1"] - 1).alias("no"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    return rows.select("doc_id", "key", plain.alias("base")).join(by_shuffle(more), same, "left").select(
        "doc_id", "key", "base", F.array_sort(F.concat("base", added)).alias("all")
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts per kind and digests of every row; counts and ``base_sha256`` are of the fixed patterns' spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return spans(docs).select(
        "doc_id", *map(count, KINDS),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("all")).alias("spans"),
        (F.size("all") - F.size("base")).cast("bigint").alias("n_added"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in angle brackets.

    Overlapping spans give one replacement, of the first kind. Spans are joined
    to rows by id and text.
    """
    key, found, at, id_ = (common.fresh(docs, n) for n in ("_key", "_spans", "_at", "_id"))
    hits = spans(docs).filter("size(all) > 0").dropDuplicates(["doc_id", "key"]).select(
        F.col("doc_id").alias(id_), F.col("key").alias(at), F.col("all").alias(found)
    )
    keyed = docs.withColumn(key, F.xxhash64(_plain(F.col("text"))))
    joined = keyed.join(by_shuffle(hits), (keyed["doc_id"].eqNullSafe(F.col(id_))) & (F.col(key) == F.col(at)), "left")
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(
        found, begin,
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(a["out"], F.array(
                    F.substring("text", a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.concat(F.lit("<"), s["kind"], F.lit(">"))
                )).alias("out"),
            )
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring("text", a["at"].cast("int") + 1, F.length("text") + 1)),
    )
    return joined.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)
