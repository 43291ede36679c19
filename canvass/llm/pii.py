r"""Personal data: fixed base patterns, and information-theoretic sanitisation of what reveals them, in DataFrame functions alone.

Base spans are leftmost, non-overlapping matches of four patterns. Around each, the CONTEXT nearest words on either side that do not
touch it are its context. Corpus
co-occurrence then tells how far a term gives an entity away: with n_e, n_t and n_te the numbers of distinct
texts that hold the entity, the term and the term in a context of the entity, and N all distinct
texts, the term discloses PMI / IC = log(p N / n_e) / log(N / n_e) of the entity's information, where p is the probability of the entity
given the term: n_te / n_t, smoothed to (n_te + PRIOR n_e / N) / (n_t + PRIOR), so that it is defined for an entity seen in one text
and is the less the fewer texts back it. Terms that disclose at least DISCLOSURE are spans of kind "term" wherever they stand as words in a document where
they are in the entity's context. Sanitising replaces base spans by their kind in angle brackets (generalised) and terms by "<term>".

Distinct texts are counted, so copies of one document are one observation. All counts are exact and cover all rows. The texts with a term in a
context are a lower bound of n_t; terms that cannot reach DISCLOSURE with it are left out. n_t itself is counted for all terms there are, each
task for its texts first, so that what is shuffled is vocabularies and not the corpus.

Cases: null and empty texts have no spans; equal rows each have their spans; rows are told apart by key and text, so that a null or
repeated doc_id is like any other; an empty table gives an empty result; further columns are ignored. No pattern recurses or goes back over a
run, so that runs of a million digits, dots or signs cost linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.common import Scratch, broadcast_by_bytes

KINDS = ("email", "ip", "card", "phone")
CONTEXT, PRIOR, DISCLOSURE = 8, 0.5, 0.9
#: Characters of a side that are searched for its words at first; of the parts that long texts are cut into for that.
REACH, PART = 192, 4096
#: Matches whose places are added up at a time.
_BLOCK = 64
#: The contract's patterns. Those that could start again at each character of a long run may only start where a run does, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every match needs, before the pattern is tried.
NEEDED = {
    "email": lambda x: x.contains("@"),
    "ip": lambda x: x.rlike(r"[0-9]\.[0-9]"),
    "card": lambda x: x.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda x: x.contains("+"),
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _kind_spans(text: Column, kind: str) -> Column:
    """Spans of one kind: the text is split at its matches, and lengths of parts and matches add up to their places.

    Places are added up within blocks of matches and then over the blocks, so that no long array is copied for each match.
    """
    matches, parts = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)
    pairs = F.zip_with(F.slice(parts, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("skip"), m.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def span(begin: Column, value: Column) -> Column:
        return F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (begin + F.length(value)).alias("end"), value.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["skip"]
        return F.struct((begin + F.length(x["value"])).alias("at"), F.concat(acc["spans"], F.array(span(begin, x["value"]))).alias("spans"))

    def blocks(pairs: Column) -> Column:
        firsts = F.when(F.size(pairs) > 0, F.sequence(F.lit(1), F.size(pairs), F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(firsts, lambda first: F.aggregate(F.slice(pairs, first, F.lit(_BLOCK)), start, step))

    def joined(done: Column) -> Column:
        ends = F.aggregate(done, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        return F.flatten(F.zip_with(done, F.slice(ends, 1, F.size(done)), lambda x, base: F.transform(x["spans"], lambda s: span(s["start"] + base, s["value"]))))

    found = F.filter(_once(_once(pairs, blocks), joined), lambda s: _valid(kind, s["value"]))
    return F.when(NEEDED[kind](text), found).otherwise(F.array().cast(_SPANS))


def _once(value: Column, use) -> Column:
    """use(value), with value computed once however often it stands in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def base_spans(text: Column) -> Column:
    """All base spans, by start and then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_kind_spans(text, kind) for kind in KINDS]))


def _entity(kind: Column, value: Column) -> Column:
    return F.concat(kind.cast("string"), F.lit(":"), F.when(kind == 0, F.lower(value)).when(kind == 1, value).otherwise(F.regexp_replace(value, "[^0-9+]", "")))


def _term(word: Column) -> Column:
    """A word without the signs around it, lower-cased."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", ""))


def _side(start: str, end: str, before: bool, edge: Column, reach: int | None = None) -> Column:
    """Words between two places of ``near`` that touch neither the span nor, unless that is the text's own edge, the end of what is searched."""
    low, high = (start, end) if reach is None else (f"greatest({start}, {end} - {reach})", end) if before else (start, f"least({end}, {start} + {reach})")
    pieces = F.split(F.expr(f"substring(near, {low} + 1, {high} - {low})"), r"[\x20\x09-\x0D]+")
    whole = edge if reach is None else edge & F.expr(f"{end} - {start} <= {reach}")
    cut = F.when(whole, 1).otherwise(2)
    inside = F.slice(pieces, cut if before else F.lit(2), F.greatest(F.size(pieces) - cut, F.lit(0)))
    words = F.filter(F.transform(inside, _term), lambda x: F.length(x) > 0)
    if reach is None:
        return words
    return _once(words, lambda x: F.when(whole | (F.size(x) >= CONTEXT), x).otherwise(_side(start, end, before, edge)))


def _sides(spans: DataFrame) -> DataFrame:
    """spans (near: a part of the text, low: its place, length, s) -> before and after, its nearest words, and complete."""
    spans = spans.withColumns({"a": F.col("s.start") - F.col("low"), "b": F.col("s.end") - F.col("low"), "n": F.length("near")})
    left, right = F.col("low") == 0, F.col("low") + F.col("n") == F.col("length")
    spans = spans.withColumns({"before": _side("0", "a", True, left, REACH), "after": _side("b", "n", False, right, REACH)})
    enough = lambda side, edge: edge | (F.size(side) >= CONTEXT)
    return spans.withColumn("complete", (F.col("b") <= F.col("n")) & enough("before", left) & enough("after", right))


def _contexts(found: DataFrame, scratch: Scratch) -> DataFrame:
    """found (row, content, text, spans) -> (row, content, entity, term) for the words near each base span.

    Spans are looked at beside the part of the text they start in and its neighbours, so that the text is not carried along for each; the
    few whose words reach further see all of it.
    """
    parts = F.transform(F.expr(f"sequence(0, cast((length(text) - 1) / {PART} as int))"), lambda k: F.struct(k.alias("k"), F.filter("spans", lambda s: F.floor(s["start"] / PART) == k).alias("spans")))
    parts = found.select("row", "content", "text", F.explode(F.filter(parts, lambda x: F.size(x["spans"]) > 0)).alias("p"))
    low = F.greatest((F.col("p.k") - 1) * PART, F.lit(0))
    near = parts.select("row", "content", F.length("text").alias("length"), low.alias("low"), F.substring(F.col("text"), low + 1, F.lit(3 * PART)).alias("near"), F.explode("p.spans").alias("s"))
    seen = scratch.save("seen", _sides(near).select("row", "content", "s", "before", "after", "complete"))
    rest = found.select("row", "text").dropDuplicates(["row"]).join(seen.where("not complete").select("row", "content", "s"), "row")
    rest = _sides(rest.select("row", "content", F.length("text").alias("length"), F.lit(0).alias("low"), F.col("text").alias("near"), "s"))
    every = seen.where("complete").select("row", "content", "s", "before", "after").union(rest.select("row", "content", "s", "before", "after"))
    words = F.array_distinct(F.concat(F.slice(F.reverse("before"), 1, CONTEXT), F.slice("after", 1, CONTEXT)))
    return every.select("row", "content", _entity(F.col("s.kind"), F.col("s.value")).alias("entity"), F.explode(words).alias("term"))


def revealing_terms(contexts: DataFrame, docs: DataFrame, scratch: Scratch, prior: float = PRIOR, disclosure: float = DISCLOSURE) -> DataFrame:
    """contexts, and docs (content, text) of the whole corpus -> (entity, term) that discloses too much."""
    n = float(docs.select("content").distinct().count() or 1)
    together = contexts.select("entity", "term", "content").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_te"))
    entities = contexts.select("entity", "content").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    at_least = contexts.select("term", "content").distinct().groupBy("term").agg(F.count("*").alias("n_t"))

    def disclosing(counted: DataFrame) -> DataFrame:
        given = (F.col("n_te") + prior * F.col("n_e") / n) / (F.col("n_t") + prior)
        pmi, ic = F.log(given * n / F.col("n_e")), F.log(F.greatest(F.lit(n), F.col("n_e") + 1.0) / F.col("n_e"))
        return counted.where(pmi >= disclosure * ic)

    hopeful = scratch.save("hopeful", disclosing(together.join(entities, "entity").join(at_least, "term")).drop("n_t"))
    candidates = scratch.save("candidates", hopeful.select("term").distinct())
    # Every text counts its own terms, which sums up before any shuffle; the copies of a text, which all hold its terms, count as one.
    copies = scratch.save("copies", docs.groupBy("content").agg(F.count("*").alias("copies")).where("copies > 1"))
    held = docs.join(broadcast_by_bytes(copies), "content", "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies"))
    words = F.array_distinct(F.transform(F.array_distinct(F.split("text", r"[\x20\x09-\x0D]+")), _term))
    counted = held.select("copies", F.explode(words).alias("term")).groupBy("term", "copies").agg(F.count("*").alias("n"))
    terms = counted.join(candidates, "term").groupBy("term").agg(F.sum(F.expr("n div copies")).alias("n_t"))
    return disclosing(hopeful.join(terms, "term")).select("entity", "term")


def _occurrences(found: DataFrame, flagged: DataFrame) -> DataFrame:
    """found (row, text, spans), flagged (row, terms) -> (row, terms: their spans), without those that a base span overlaps: they are gone with it."""
    held = found.join(broadcast_by_bytes(flagged), "row")
    words = held.select("row", "terms", F.posexplode(F.split("text", r"[\x20\x09-\x0D]")).alias("at", "word"))
    before = F.sum(F.length("word") + 1).over(Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    placed = words.withColumns({"begin": F.coalesce(before, F.lit(0)), "term": _term(F.col("word"))}).where(F.array_contains("terms", F.col("term")))
    begin = (F.col("begin") + F.length("word") - F.length(F.regexp_replace("word", r"^[^\p{L}\p{N}]++", ""))).cast("int")
    placed = placed.select("row", begin.alias("start"), (begin + F.length("term")).alias("end"), "term")
    # In the order of places, a span comes before the words that end after it starts; the furthest end so far tells whether it reaches into them.
    base = held.select("row", F.explode("spans").alias("s")).select("row", F.col("s.start").alias("place"), F.lit(0).alias("turn"), F.col("s.end").alias("reach"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("term"))
    both = base.union(placed.select("row", F.col("end") - 1, F.lit(1), F.lit(None).cast("int"), "start", "term"))
    reach = F.max("reach").over(Window.partitionBy("row").orderBy("place", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    free = both.withColumn("reach", reach).where("term is not null and coalesce(reach, 0) <= start")
    return free.groupBy("row").agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind"), (F.col("place") + 1).alias("end"), F.col("term").alias("value"))).alias("terms"))


def _row(key: Column, text: Column) -> Column:
    return F.xxhash64(key.cast("string"), text)


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs -> docs with base and spans added, in place of columns of those names: base spans, and those with revealing terms, each sorted by start and kind."""
    scratch, held = Scratch(docs.sparkSession, "pii"), F.coalesce(F.col(text), F.lit(""))
    own = docs.select(_row(F.col(key), held).alias("row"), F.xxhash64(held).alias("content"), held.alias("text"))
    found = own.select("row", "content", "text", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)
    found = scratch.save("found", found)
    contexts = scratch.save("contexts", _contexts(found, scratch))
    secrets = scratch.save("secrets", revealing_terms(contexts, own, scratch))
    flagged = contexts.join(broadcast_by_bytes(secrets), ["entity", "term"]).groupBy("row").agg(F.collect_set("term").alias("terms"))
    flagged = scratch.save("flagged", flagged)
    terms = scratch.save("terms", _occurrences(found.dropDuplicates(["row"]), flagged))
    scratch.drop("found", "seen", "contexts", "hopeful", "candidates", "copies", "secrets", "flagged")
    names = [c for c in docs.columns if c not in ("base", "spans")]
    terms = broadcast_by_bytes(terms.select("row", "terms"))
    # Base spans are found anew: that costs less than to carry them to the rows they belong to.
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("given"), _row(F.col(key), held).alias("row"), base_spans(F.col(text)).alias("base"))
    out = given.join(terms, "row", "left")
    base, extra = F.col("base"), F.coalesce("terms", F.array().cast(_SPANS))
    return out.select(*[F.col(f"given.`{c}`") for c in names], base.alias("base"), F.array_sort(F.concat(base, extra)).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts, as far as the last reaches."""
    names = F.array(*[F.lit(f"<{k}>") for k in (*KINDS, "term")])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        cut = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["parts"], cut)).otherwise(acc["parts"]).alias("parts"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
