"""Personal data by patterns, and by contexts learned from what the patterns find; DataFrame functions alone.

Base: e-mail addresses, IP addresses, card and phone numbers by regular expression, leftmost and not overlapping within a
kind. Possessive and anchored forms give the same matches as the plain ones in time linear in the text.

Bootstrapping: base finds are seeds. The two words before a find are its pattern, however far they reach back; a word of
more than ``WORD`` code points is told by its last ones. Tokens that look like identifiers but are not base finds are
candidates, each with its pattern too. Patterns and the values they occur with form a graph. A pattern's confidence for a
kind is the mean score of its distinct values, damped by ``PRIOR`` values of score 0; a value that is no seed has for a
pattern the score 1 - product(1 - confidence) over its other patterns. Confidences only rise from round to round; when none
rises by more than ``SETTLED`` any more, candidates of the kind's shape are reported where they stand after a pattern of
``CONFIDENT`` or more.

The finds of a text are worked on in parts of ``PART``, so that the work on a text is about linear in its finds.

Edge cases: a null text is empty. Rows are told apart by the hash of id and text: equal rows have equal finds. Null ids are
kept. Overlapping finds of several kinds are all reported; ``mask`` replaces what they cover together once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

KINDS = ["email", "ip", "card", "phone"]
PRIOR = 2
CONFIDENT = 0.8
SETTLED = 0.01
WORD = 64
PART = 256

_LOCAL = "A-Za-z0-9._%+-"
# a match can only begin at the start of a run of its characters or where the last match ended
_PATTERNS = {
    "email": (r"@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9](?:\x20?-?[0-9]){12}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_CANDIDATE = r"(?<!\S)(?=(?:[^\s0-9]*+[0-9]){5}|[^\s@]++@)\S*[0-9A-Za-z]"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_MET = "array<struct<start:int,end:int,value:string,pattern:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(array: Column, size: Column) -> Column:
    """An array in slices of ``PART``; one empty slice of an empty array."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / PART), F.lit(0)).cast("int")), lambda k: F.slice(array, k * PART + 1, PART))


def _last_words(text: Column) -> Column:
    """The last three words of a text (the third may be cut by a find), single spaces between and after them."""
    words = F.regexp_replace(F.regexp_extract(text, r"(?<!\S)\S++(?:\s++\S++){0,2}\s*+$", 0), r"\s+", " ")
    return F.regexp_replace(words, rf"\S+(?=\S{{{WORD}}})", "")


def _pattern(before: Column) -> Column:
    """The two words before a place, in lower case, digits as #; null if there are none."""
    words = F.regexp_extract(before, r"(\S+ \S+) $", 1)
    return F.when(words != "", F.regexp_replace(F.lower(words), "[0-9]", "#"))


def matches(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<start, end, value, pattern>> of the matches of a regular expression, in code points."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # there is a gap more than matches
    pieces = F.filter(F.zip_with(found, gaps, lambda m, gap: F.struct(m.alias("m"), gap.alias("gap"))), lambda p: p["m"].isNotNull())

    def skip(state: Column, part: Column) -> Column:
        size = F.aggregate(part, F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["m"]))
        left = _last_words(F.concat(state["left"], F.array_join(F.transform(part, lambda p: F.concat(p["gap"], p["m"])), "")))
        begun = F.struct(state["at"].alias("at"), state["left"].alias("left"), part.alias("part"))
        return F.struct((state["at"] + size).alias("at"), left.alias("left"), F.array_append(state["out"], begun).alias("out"))

    def step(state: Column, p: Column) -> Column:
        def placed(a: Column) -> Column:
            def known(before: Column) -> Column:
                b = a + F.length(p["m"])
                one = F.struct(a.alias("start"), b.alias("end"), p["m"].alias("value"), _pattern(before).alias("pattern"))
                return F.struct(b.alias("at"), F.concat(before, p["m"]).alias("left"), F.array_append(state["out"], one).alias("out"))

            return _let(_last_words(F.concat(state["left"], p["gap"])), known)

        return _let(state["at"] + F.length(p["gap"]), placed)

    nothing = F.array().cast("array<struct<at:int,left:string,part:array<struct<m:string,gap:string>>>>")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("left"), nothing.alias("out"))
    begun = _let(pieces, lambda x: F.aggregate(_parts(x, F.size(x)), start, skip)["out"])
    state = lambda o: F.struct(o["at"].alias("at"), o["left"].alias("left"), F.array().cast(_MET).alias("out"))
    return F.flatten(F.transform(begun, lambda o: F.aggregate(o["part"], state(o), step)["out"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _looks_like(kind: str, value: Column) -> Column:
    """Shapes that an unseen identifier of a kind may have."""
    n = F.length(_digits(value))
    return {
        "email": value.contains("@"),
        "ip": value.rlike(r"^[0-9A-Fa-f]*(?:[:.][0-9A-Fa-f]*){2,}$"),
        "card": value.rlike(r"^[0-9-]+$") & n.between(12, 19),
        "phone": value.rlike(r"^[(+]?[0-9().+/-]+$") & n.between(7, 15),
    }[kind]


def base_finds(docs: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """``docs`` with ARRAY<STRUCT<kind, start, end, value, pattern>>: kinds in the order of ``KINDS``, then by start."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(_MET)
    docs = docs.withColumns({f"_{k}": F.when(t.rlike(need), matches(t, p)).otherwise(none) for k, (need, p) in _PATTERNS.items()})

    def valid(kind: str) -> Column:
        right = F.filter(f"_{kind}", lambda m: _valid(kind, m["value"]))
        place = lambda m: [m[c].alias(c) for c in ("start", "end", "value", "pattern")]
        return F.transform(right, lambda m: F.struct(F.lit(kind).alias("kind"), *place(m)))

    kinds = [valid(k) for k in KINDS]
    return docs.withColumn(out, F.concat(*kinds)).drop(*[f"_{k}" for k in KINDS])


def _score(graph: DataFrame) -> DataFrame:
    """Confidence of (pattern, kind) when it has settled. ``graph`` has (pattern, value, seed), a seed's kind or null."""
    sizes = graph.groupBy("pattern").agg(F.countDistinct("value").alias("n"))
    seeds = graph.filter("seed is not null").select("pattern", "value", F.col("seed").alias("kind")).distinct()
    firm = materialize(seeds.groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("sum")), "firm")
    sizes = materialize(sizes, "sizes")
    # a value of one pattern is told nothing by others: it counts in ``sizes`` alone
    loose = materialize(graph.filter("seed is null").select("pattern", "value").distinct(), "loose")
    spread = materialize(loose.groupBy("value").count().filter("count > 1").select("value"), "spread")
    loose = materialize(loose.join(spread, "value").select("pattern", "value"), "shared")

    def confidence(sums: DataFrame) -> DataFrame:
        return sums.join(sizes, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("n") + PRIOR)).alias("confidence"))

    scored, rise = materialize(confidence(firm), "scored"), 1.0
    while rise > SETTLED:
        # what a pattern says of a value does not come back to it: its own vote is taken out again
        vote = F.log1p(-F.least("confidence", F.lit(0.999))).alias("vote")
        votes = materialize(loose.join(scored, "pattern").select("pattern", "value", "kind", vote), "votes")
        sums = materialize(votes.groupBy("value", "kind").agg(F.sum("vote").alias("all")), "values")
        heard = loose.join(sums, "value").join(votes, ["pattern", "value", "kind"], "left")
        found = heard.groupBy("pattern", "kind").agg(F.sum(1 - F.exp(F.col("all") - F.coalesce("vote", F.lit(0.0)))).alias("sum"))
        was = scored.withColumnRenamed("confidence", "was")
        more = confidence(firm.union(found).groupBy("pattern", "kind").agg(F.sum("sum").alias("sum"))).join(was, ["pattern", "kind"], "left")
        more = materialize(more.withColumn("rise", F.col("confidence") - F.coalesce("was", F.lit(0.0))), "scored")
        scored, rise = more.select("pattern", "kind", "confidence"), more.agg(F.max("rise")).first()[0] or 0.0
    return scored


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, doc_id, base, finds) for every row; finds are base and learned ones, by kind and start."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = base_finds(rows).withColumn("_tokens", F.when(t.rlike("[0-9@]"), matches(t, _CANDIDATE)).otherwise(F.array().cast(_MET)))

    def bounded(part: Column) -> Column:
        ends = [f(F.transform(part, lambda b: b[c])).alias(c) for f, c in ((F.array_min, "start"), (F.array_max, "end"))]
        return F.struct(*ends, part.alias("part"))

    def free(parts: Column) -> Column:
        meets = lambda x, c: (x["start"] < c["end"]) & (c["start"] < x["end"])
        inside = lambda c: F.exists(parts, lambda p: meets(p, c) & F.exists(p["part"], lambda b: meets(b, c)))
        return F.filter("_tokens", lambda c: ~F.coalesce(inside(c), F.lit(False)))

    def occurrence(m: Column, seed: Column) -> Column:
        place = [m[c].alias(c) for c in ("start", "end", "value")]
        return F.struct(m["pattern"].alias("pattern"), seed.alias("seed"), *place)

    met = F.concat(
        F.transform("base", lambda m: occurrence(m, m["kind"])),
        F.transform(_let(F.transform(_parts(F.col("base"), F.size("base")), bounded), free), lambda m: occurrence(m, F.lit(None).cast("string"))),
    )
    base = F.transform("base", lambda m: F.struct(*[m[c].alias(c) for c in ("kind", "start", "end")]))
    rows = materialize(rows.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", base.alias("base"), met.alias("met")), "finds")
    # every pattern is in the graph: one without seeds may share values with confident ones
    met = rows.select("row", F.explode("met").alias("m")).select("row", "m.*").filter("pattern is not null")
    graph = materialize(met.select("pattern", "value", "seed").distinct(), "graph")
    firm = materialize(_score(graph).filter(F.col("confidence") >= CONFIDENT).select("pattern", "kind"), "confident")
    new = met.filter("seed is null").join(firm, "pattern")
    fits = F.lit(False)
    for k in KINDS:
        fits = fits | ((F.col("kind") == k) & _looks_like(k, F.col("value")))
    new = new.filter(fits).groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("new"))
    joined = rows.select("row", "doc_id", "base").join(materialize(new, "learned"), "row", "left")
    place = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    order = lambda a, b: F.when(F.struct(place(a), a["start"], a["end"]) < F.struct(place(b), b["start"], b["end"]), -1).otherwise(1)
    new = F.coalesce("new", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    every = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", new), order))
    return joined.select("row", "doc_id", "base", every.alias("finds"))


def listed(finds: Column | str) -> Column:
    """kind:start:end of finds, joined by commas."""
    return F.array_join(F.transform(finds, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def mask(text: Column, finds: Column) -> Column:
    """``text`` with what finds cover replaced by the kind of the first in brackets."""
    ordered = F.array_sort(F.transform(finds, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))))

    def step(text: Column, first: Column):
        """Finds replaced in a piece of the text that begins at ``first``."""

        def replace(s: Column, m: Column) -> Column:
            piece = F.concat(F.substring(text, s["at"] - first + 1, m["start"] - s["at"]), F.lit("["), F.upper(m["kind"]), F.lit("]"))
            done = F.when(m["start"] >= s["at"], F.array_append(s["done"], piece)).otherwise(s["done"])
            return F.struct(F.greatest(s["at"], m["end"]).alias("at"), done.alias("done"))

        return replace

    def state(at: Column) -> Column:
        return F.struct(at.alias("at"), F.array().cast("array<string>").alias("done"))

    def part(s: Column, finds: Column) -> Column:
        end = F.greatest(s["at"], F.array_max(F.transform(finds, lambda m: m["end"])))

        def replaced(piece: Column) -> Column:
            return F.aggregate(finds, state(s["at"]), step(piece, s["at"]), lambda x: F.array_join(x["done"], ""))

        done = _let(F.substring(text, s["at"] + 1, end - s["at"]), replaced)
        return F.struct(end.alias("at"), F.array_append(s["done"], done).alias("done"))

    finish = lambda s: F.concat(F.array_join(s["done"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    masked = _let(ordered, lambda x: F.aggregate(_parts(x, F.size(x)), state(F.lit(0)), part, finish))
    return F.when(F.size(finds) > 0, masked).otherwise(text)


def masked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with personal data masked in the text. Other columns stay; null texts stay null."""
    found = find(docs, text, doc_id).filter(F.size("finds") > 0).select("row", "finds").dropDuplicates(["row"])
    found = materialize(found.select(F.col("row").alias("_row"), F.col("finds").alias("_finds")), "masks")
    joined = docs.withColumn("_row", F.xxhash64(doc_id, text)).join(found, "_row", "left")
    done = F.when(F.col("_finds").isNull(), F.col(text)).otherwise(mask(F.col(text), F.col("_finds")))
    return joined.withColumn(text, done).select(*docs.columns)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("finds").alias("spans"))
