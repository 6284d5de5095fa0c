"""The numbered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contained_items
from .exact_dedup import exact_groups
from .filter_audit import audit_filters
from .frames import table
from .html_extract import extract_text
from .language_id import identify_languages
from .license_scan import scan_licenses
from .lloyd import compress_vectors
from .lm_score import score_documents
from .multi_index import near_vectors
from .near_dedup import near_groups
from .packing import pack
from .pii import pseudonymise
from .secret_scan import scan_secrets


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), key=spark.conf.get("spark.tallyloom.surrogateKey", "a key for synthetic tables"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), digest=True)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), capacity=4096)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), leave_one_out=True)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_html_extract, op2_decontaminate, op3_license_scan, op4_surrogates, op5_exact_dedup, op6_pattern_packing, op7_near_dedup, op8_lm_score, op9_language_id, op10_secret_scan,
    op11_multi_index, op12_delta_lloyd, op13_filter_audit,
)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SHINGLES = """SELECT DISTINCT {id}, unnest(list_transform(range(greatest(len(w) - 4, 0)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS shingle
        FROM (SELECT {id}, regexp_extract_all({fold}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {source})"""

_FINITE = "coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0, FALSE)"


def _lloyd_sql(rounds: int = 4) -> str:
    """Lloyd's rounds over 4 parts, each round's assignment and entries as tables of their own; dots of integers below 2**53 are exact."""
    nearest = "{name} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, min({{'d': list_inner_product(c, c) - 2 * list_inner_product(x, c), 'e': entry}}) AS best FROM p JOIN {books} USING (part) GROUP BY vec_id, part)"
    steps = []
    for r in range(rounds):
        steps.append(nearest.format(name=f"a{r}", books=f"b{r}"))
        steps.append(f"""s{r} AS (SELECT part, best.e AS entry, i, sum(CAST(x[i] AS BIGINT)) AS total, count(*) AS n FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM p))) AS i) GROUP BY part, best.e, i)""")
        steps.append(f"""n{r} AS (SELECT part, entry, list(CAST((total - ((total % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM s{r} GROUP BY part, entry)""")
        steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN n{r} n ON b.part = n.part AND b.entry = n.entry)""")
    steps.append(nearest.format(name="f", books=f"b{rounds}"))
    return f"""
        WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_FINITE}),
        p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM k, (SELECT unnest(range(4)) AS part)),
        b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < 256),
        {", ".join(steps)},
        coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d + list_inner_product(x, x)) AS BIGINT) AS error FROM f GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
          (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
        FROM coded JOIN k USING (vec_id)"""


_AUDIT = """
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
        g AS (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS INT)
            + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT) AS mask, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic FROM w LEFT JOIN g USING (doc_id)),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
        e AS (SELECT part, s.state, k.k, sum(CASE WHEN mask & s.state = 0 THEN n ELSE 0 END) AS before, sum(CASE WHEN mask & s.state = 0 AND (mask >> k.k) & 1 = 1 THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN mask & s.state = 0 AND (mask >> k.k) & 1 = 1 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & s.state = 0 AND (mask >> k.k) & 1 = 1 THEN toxic ELSE 0 END) AS toxic_lost
          FROM c, (SELECT unnest(range(32)) AS state) s, (SELECT unnest(range(5)) AS k) k WHERE (s.state >> k.k) & 1 = 0 GROUP BY part, s.state, k.k),
        l AS (SELECT unnest(range(5)) AS k, unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks, a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
        st AS (SELECT filter_order, CAST(step AS INT) AS step, ks[step] AS k, CAST(coalesce(list_sum(list_transform(ks[1:step - 1], lambda x: 1 << x)), 0) AS BIGINT) AS state FROM o, (SELECT unnest(range(1, 6)) AS step)),
        a AS (SELECT part, filter_order, step, st.k, before, removed, good_lost, toxic_lost FROM st JOIN e ON st.state = e.state AND st.k = e.k),
        u AS (SELECT part, k, sum(CASE WHEN state = 0 THEN removed ELSE 0 END) AS fails, sum(CASE WHEN bit_count(state) = 4 THEN removed ELSE 0 END) AS unique_fails FROM e GROUP BY part, k),
        sh AS (SELECT part, k, sum(removed) AS shapley FROM a GROUP BY part, k)
        SELECT part, filter_order, step, CAST(before - removed AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(fails - removed AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
          CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
        FROM a JOIN u USING (part, k) JOIN sh USING (part, k)"""


ORACLES: dict[str, str] = {
    "op2_decontaminate": f"""
        WITH q AS ({_SHINGLES.format(id="item_id", fold=_FOLD, source="benchmark")}),
        d AS ({_SHINGLES.format(id="doc_id", fold=_FOLD, source="documents")}),
        n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id),
        s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM q JOIN d USING (shingle) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM s JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item
    """,
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_FOLD}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    # the index misses at most a few links in a thousand right at the threshold; all links there are is what it is held to
    "op11_multi_index": f"""
        WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
        r AS (SELECT a AS vec_id, b AS other FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a), c AS (SELECT vec_id, least(vec_id, min(other)) AS component_id FROM r GROUP BY vec_id)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
        FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
    """,
    "op12_delta_lloyd": _lloyd_sql(),
    "op13_filter_audit": _AUDIT,
}
