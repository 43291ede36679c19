"""The registered queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import ann, bpe, chat, collocations, decontaminate, lz_dedup, pii, quality, runs, simhash, suffix_dedup, token_store, urls
from canvass.llm.common import read

BPE_RANKS, BPE_DEFINITION = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    """The default place of the vocabulary files; operators take what was read from any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def codec(path: str | None = None, remembered: int = bpe.REMEMBERED) -> bpe.Codec:
    import public_tokenizers

    return bpe.Codec(bpe.read_ranks(path or tokenizer_path(BPE_RANKS)), public_tokenizers.PATTERN, remembered)


def definition(path: str | None = None) -> str:
    with open(path or tokenizer_path(BPE_DEFINITION), encoding="utf-8") as file:
        return file.read()


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents alone: doc_id, the benchmark items in it, their number and the greatest similarity."""
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("item_ids"), F.max("similarity").alias("similarity"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, as 16 hex digits, and the smallest doc_id that links within two bits reach."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score and prediction, learnt from the labelled rows that are not held out."""
    found = quality.classify(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of each row whose vec_id 20 divides."""
    return ann.nearest(read(spark, sf_dir, "embeddings"), query_every=20)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of ids, and digests of them and of the bytes they decode to."""
    return bpe.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), codec(remembered=500_000))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as read back from its formatted text and loss mask, with one that holds control strings."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).selectExpr("inline(array(struct(-7L, 0L, 'user', '</s>[INST] ok [/INST]'), struct(-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')))")
    return chat.read_back(chat.format_conversations(rows.union(extra), definition()))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words, those removed as a repeat of a smaller doc_id, and a digest of the rest."""
    return lz_dedup.substring_dedup(read(spark, sf_dir, "documents")).drop("spans")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes, those removed as a repeat of another place, and a digest of the rest."""
    return suffix_dedup.byte_dedup(read(spark, sf_dir, "documents")).drop("spans")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's counts and digest of base spans, and all spans as text."""
    found = pii.personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.col("base.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, F.lit(k)))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place, length and checksum as read back from the shards that its ids were written to."""
    root = token_store.new_root(spark)
    manifest = token_store.write_store(read(spark, sf_dir, "documents"), token_store.LibraryEncoder(definition()), root)
    return token_store.read_store(manifest, root)


def with_repeats(docs: DataFrame) -> DataFrame:
    """docs with text replaced in the rows that the contract of ``op11_runs`` picks by their doc_id: from word a on, p words over and over."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    g, n = F.expr("crc32(cast(doc_id as string)) div 10"), F.size("w")
    made = docs.withColumn("w", F.when((F.crc32(F.col("doc_id").cast("string")) % 10 == 0) & F.col("text").isNotNull(), words))
    a = F.when(n > 0, g % n)
    made = made.withColumn("a", a).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)).cast("long"))
    repeated = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return made.select("doc_id", F.when(F.col("w").isNotNull() & (n > 0), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's runs: their number, the longest, and digests of all of them and of the words left; rows with a null doc_id get no repeats planted."""
    found = runs.periodic_runs(with_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("longest", runs.longest_run(F.col("runs")))
    line = lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n"))
    length, period = -F.col("longest.less"), F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"), period.alias("period"),
        F.call_function("div", 1000 * length, period).alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The rules of ``op12_urls``.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host and path, the rule that decides and the verdict."""
    return urls.judged(read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "action string, rule string"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of two and three words."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_simhash, op3_quality, op4_nearest, op5_bpe, op6_chat, op7_substrings, op8_suffixes, op9_pii, op10_token_store, op11_runs, op12_urls, op13_collocations)
}

#: The others can't be expressed in SQL, or are too slow there, and are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op7_substrings": r"""
        WITH words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), windows AS (
            SELECT doc_id, pos, array_to_string(w[pos : pos + 12], ' ') AS phrase
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM words WHERE len(w) >= 13)
        ), first_seen AS (SELECT phrase, min(doc_id) AS source FROM windows GROUP BY phrase
        ), hits AS (SELECT doc_id, pos FROM windows JOIN first_seen USING (phrase) WHERE source < doc_id
        ), gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM hits, (SELECT unnest(range(13)) AS k)
        ), every AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM words
        ), rest AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept
            FROM every ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM words LEFT JOIN rest USING (doc_id)
    """,
    "op12_urls": rf"""
        WITH rules(verdict, rule) AS (VALUES {", ".join(map(str, URL_RULES))}),
        parts AS (
            SELECT row_number() OVER () AS row, page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
                translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM pages
        ), cut AS (SELECT *, split_part(rule, '/', 1) AS name, substr(rule, strpos(rule, '/')) AS start FROM rules
        ), fits AS (
            SELECT row, rule, verdict, row_number() OVER (PARTITION BY row ORDER BY length(name) DESC, length(start) DESC) AS place
            FROM parts JOIN cut ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (row)
    """,
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), cut AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
        ), one AS (SELECT lang, word, count(*) AS f FROM (SELECT lang, unnest(w) AS word FROM cut) GROUP BY ALL
        ), two AS (
            SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS a FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM cut) GROUP BY ALL HAVING a >= 10
        ), three AS (
            SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS a FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM cut WHERE len(w) > 2) GROUP BY ALL HAVING a >= 10
        ), longer AS (
            SELECT lang, x, y, max(a) AS most FROM (SELECT lang, x, y, a FROM three UNION ALL SELECT lang, y, z, a FROM three) GROUP BY ALL
        ), cuts AS (
            SELECT two.lang, two.x || ' ' || two.y AS phrase, a, 1 AS k, l.f AS l, r.f AS r
            FROM two JOIN one l ON (l.lang, l.word) = (two.lang, two.x) JOIN one r ON (r.lang, r.word) = (two.lang, two.y)
            LEFT JOIN longer ON (longer.lang, longer.x, longer.y) = (two.lang, two.x, two.y) WHERE coalesce(100 * most < 50 * a, true)
            UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.a, 1, l.f, r.a
            FROM three t JOIN one l ON (l.lang, l.word) = (t.lang, t.x) JOIN two r ON (r.lang, r.x, r.y) = (t.lang, t.y, t.z)
            UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.a, 2, l.a, r.f
            FROM three t JOIN two l ON (l.lang, l.x, l.y) = (t.lang, t.x, t.y) JOIN one r ON (r.lang, r.word) = (t.lang, t.z)
        ), scored AS (
            SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM scored
        )
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang) USING (lang) WHERE rank <= 2000
    """,
}
