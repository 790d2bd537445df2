"""One query per operator, over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate,
    fill_middle,
    fingerprints,
    lexical,
    lm,
    minhash,
    mixing,
    quality,
    repeats,
    sharding,
    token_counts,
    token_files,
    url_rules,
)
from tidemark.llm.staging import staged
from tidemark.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return run

    return register


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_sharding")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: counts at most one apart."""
    text = F.col("record.text")
    return sharding.shuffled_shards(table(spark, sf_dir, "documents")).select(
        F.col("record.doc_id").alias("doc_id"),
        sharding.text_bytes(text).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    "op4_url_filters",
    r"""
    WITH cut AS (
      SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
    ), parts AS (
      SELECT page_id,
        coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
      FROM cut
    ), ruled AS (
      SELECT *, CASE
        WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
      FROM parts
    )
    SELECT page_id, host, path, rule,
      CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
    """,
)
def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judged(pages).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op6_mixing",
    r"""
    WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        md5(concat_ws(':', '23', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS draw FROM documents
    ), sources AS (
      SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
      FROM sized GROUP BY source
    ), levels AS (
      -- clamped are the sources with the lowest size per weight: the fewest that make all others fit
      SELECT *, sum(3 * source_size) OVER low AS cap_below, sum(weight) OVER high AS weight_above,
        sum(source_size) OVER () AS total
      FROM sources
      WINDOW low AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        high AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ), level AS (
      SELECT total - coalesce(cap_below, 0) AS rest, weight_above FROM levels
      WHERE 3 * source_size * weight_above >= (total - coalesce(cap_below, 0)) * weight
      ORDER BY source_size::DOUBLE / weight, source NULLS LAST LIMIT 1
    ), targets AS (
      SELECT source, source_size, CASE WHEN 3 * source_size * weight_above < rest * weight THEN (3 * source_size)::DOUBLE
        ELSE (weight * rest)::DOUBLE / weight_above::DOUBLE END AS target
      FROM sources, level
    ), wanted AS (
      SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets
    ), running AS (
      SELECT d.doc_id, d.size, w.*,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
        sum(d.size) OVER (PARTITION BY d.source, d.draw) AS own
      FROM sized d JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source
    )
    SELECT doc_id, size::BIGINT AS size, source_size, target,
      (size * (whole + CASE WHEN upto - own / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM running
    """,
)
def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select(
        F.col("record.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


@query("op7_token_counts")
def token_counts_(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.counted(docs, tokenizer_path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op9_token_files")
def token_files_(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_documents(spark, path)


def quality_sql() -> str:
    """The whole op8 in SQL: counts, holdout, binomial tests by sums of binomial terms, verdicts."""
    level = f"({quality.ERROR} / ({len(quality.RULES)} * (SELECT count(*) FROM strata)))"
    allowed = quality.FALSE_REJECTIONS / len(quality.RULES)
    tests, verdicts = [], []
    for rule, (top, bottom, side, grid) in quality.RULES.items():
        sign = ">" if side == "above" else "<"
        for i, cutoff in enumerate(grid):
            tests.append(f"SELECT '{rule}' AS rule, {i} AS pos, {cutoff}::DOUBLE AS cutoff")
        verdicts.append(
            f"coalesce({top} / nullif({bottom}, 0)::DOUBLE {sign} "
            f"(SELECT cutoff FROM taken t WHERE t.rule = '{rule}' AND t.lang IS NOT DISTINCT FROM c.lang), false)"
        )
    hit = " ".join(
        f"WHEN '{rule}' THEN coalesce({top} / nullif({bottom}, 0)::DOUBLE {'>' if side == 'above' else '<'} cutoff, false)"
        for rule, (top, bottom, side, _) in quality.RULES.items()
    )
    return rf"""
    WITH texts AS (
      SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), windows AS (
      SELECT r, unnest(range(1, len(words) - 6)) AS pos,
        unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS win
      FROM texts WHERE len(words) >= 8
    ), often AS (
      SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1
    ), repeated AS (
      SELECT r, count(DISTINCT word) AS n_repeat_words FROM (SELECT r, unnest(range(pos, pos + 8)) AS word FROM often) GROUP BY r
    ), lines AS (
      SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
    ), counts AS MATERIALIZED (
      SELECT doc_id, lang, len(words)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(n_lines, 0)::BIGINT AS n_lines
      FROM texts LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r)
    ), based AS (
      SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
    ), good AS (
      SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(toxic) = 0
    ), held AS MATERIALIZED (
      SELECT based.* FROM based JOIN good USING (doc_id) WHERE NOT base_failed
    ), strata AS MATERIALIZED (
      SELECT lang, count(*) AS n FROM held GROUP BY lang
    ), tests AS ({" UNION ALL ".join(tests)}), tested AS (
      SELECT held.lang, rule, pos, cutoff, count(*) AS n, count(*) FILTER (CASE rule {hit} END) AS k
      FROM held, tests GROUP BY held.lang, rule, pos, cutoff
    ), certified AS (
      SELECT lang, rule, pos, cutoff, (
        SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({allowed}) + (n - i) * ln(1 - {allowed})))
        FROM range(0, k + 1) AS terms(i)) <= {level} AS good
      FROM tested
    ), taken AS MATERIALIZED (
      SELECT lang, rule, max_by(cutoff, pos) AS cutoff FROM (
        SELECT *, bool_and(good) OVER (PARTITION BY lang, rule ORDER BY pos) AS all_good FROM certified
      ) WHERE all_good GROUP BY lang, rule
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT (base_failed OR {" OR ".join(verdicts)}) AS kept FROM based c
    """


@query("op8_quality_rules", quality_sql())
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    counts = staged(quality.measured(docs).drop("text"), "counts")
    cutoffs = quality.certified_cutoffs(counts, table(spark, sf_dir, "labels"))
    return quality.judged(counts, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op1_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = decontaminate.question_and_answer(table(spark, sf_dir, "benchmark"))
    return decontaminate.leaks(table(spark, sf_dir, "documents"), items)


@query("op3_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs).select("doc_id", "class_id", "class_size")


@query("op5_repeated_strings")
def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("rest.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op10_lm_scores")
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "op11_fill_middle",
    r"""
    WITH cut AS (
      SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
        sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
    ), drawn AS (
      SELECT doc_id, text, units, len(units) AS n,
        ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
      FROM cut
    ), parts AS (
      SELECT doc_id, text, n, CASE
          WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
          WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
        array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
        array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix
      FROM drawn
    )
    SELECT doc_id, n::BIGINT AS n, form,
      CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
      sha256(text) AS restored_sha256 FROM parts
    """,
)
def fill_middle_(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.filled_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        F.col("record.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("fim", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("fim"), F.col("form")), 256).alias("restored_sha256"),
    )


@query("op12_simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


@query(
    "op13_lexical_search",
    r"""
    WITH texts AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM documents
    ), items AS (
      SELECT row_number() OVER () AS i, item_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM benchmark
    ), totals AS (
      SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM texts WHERE len(terms) > 0
    ), norms AS (
      SELECT r, doc_id, 100 - 50 + ((50 * len(terms) * n_docs) // n_terms) AS m FROM texts, totals WHERE len(terms) > 0
    ), asked AS (
      SELECT i, item_id, term FROM (SELECT DISTINCT i, item_id, unnest(terms) AS term FROM items)
    ), counts AS (
      SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM texts)
      WHERE term IN (SELECT term FROM asked) GROUP BY r, term
    ), weights AS (
      SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM counts, totals GROUP BY term
    ), scored AS (
      SELECT i, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN norms USING (r) GROUP BY i, item_id, r, doc_id
    )
    SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 50
    """,
)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
