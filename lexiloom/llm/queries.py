"""The operators on the tables, each with what its digest adds, and SQL for those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.additive_quality import additive_quality
from lexiloom.llm.embedding_dedup import embedding_dedup
from lexiloom.llm.html_extract import extract_main_text
from lexiloom.llm.jaccard_join import jaccard_join
from lexiloom.llm.kd_shards import kd_shards
from lexiloom.llm.lm_score import lm_score
from lexiloom.llm.merkle import merkle_manifest
from lexiloom.llm.name_join import name_join
from lexiloom.llm.packing import pack
from lexiloom.llm.permutation_index import permutation_search
from lexiloom.llm.pu_toxicity import pu_toxicity
from lexiloom.llm.quotation_links import quotation_links
from lexiloom.llm.soft_mixing import soft_mix


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(id_: str, parts: int) -> Column:
    return F.crc32(F.col(id_).cast("string")) % parts


def domain() -> Column:
    """A labelled row's domain: toxic, else by quality."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


def op1_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(_table(spark, sf_dir, "documents"), shards=40)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(_fold("doc_id", 5) == 1, F.lit(False))
    scored = lm_score(_table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates for 80 % high, 15 % low and 5 % toxic tokens."""
    return soft_mix(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), domain(), {"high": 0.80, "low": 0.15, "toxic": 0.05}
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op7_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(_fold("doc_id", 3) == 1, F.lit(False))
    scored = pu_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op10_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation_links(_table(spark, sf_dir, "conversations"))


def op11_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(_fold("doc_id", 4) == 2, F.lit(False))
    scored = additive_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op12_name_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendors = _table(spark, sf_dir, "vendors")
    return name_join(_table(spark, sf_dir, "clients"), vendors, seed=F.crc32(F.col("vendor_id").cast("string")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return merkle_manifest(docs, tampered=_fold("doc_id", 3) == 0).drop("path")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_wrappers, op2_kd_shards, op3_lm_score, op4_soft_mixing, op5_best_fit_packing, op6_embedding_dedup, op7_pu_toxicity,
        op8_permutation_index, op9_jaccard_join, op10_quotation_links,
        op11_additive_quality, op12_name_automaton, op13_merkle_manifest,
    )
}

#: crc32 of the decimals of the column k of a table ids, as (k, crc).
_CRC = """(SELECT k, (WITH RECURSIVE b AS (SELECT 0 AS i, 4294967295::BIGINT AS r UNION ALL
        SELECT i + 1, list_reduce(range(9), lambda a, x: CASE WHEN x = 0 THEN a WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END,
            xor(r, ascii(substr(k::VARCHAR, i + 1, 1)))) FROM b WHERE i < length(k::VARCHAR)) SELECT xor(max_by(r, i), 4294967295) FROM b) AS crc FROM ids)"""

ORACLES: dict[str, str] = {
    "op1_html_wrappers": r"""
        WITH cut AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g') AS body FROM pages),
        blocks AS (SELECT page_id, url, list_transform(string_split_regex(replace(body, '<br>', ' '), '</?(?:p|h1)>'),
            lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS b FROM cut)
        SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) AS text,
               length(array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)))::BIGINT AS n_chars FROM blocks""",
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
        comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x), deg AS (SELECT x, count(*) AS n FROM link GROUP BY x)
        SELECT v.vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept
        FROM v JOIN comp ON comp.x = v.vec_id LEFT JOIN deg ON deg.x = v.vec_id""",
    "op9_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(t) < 4 THEN array_to_string(t, ' ') ELSE array_to_string(t[i:i + 3], ' ') END AS g
              FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 3, 1) + 1)) AS i FROM w WHERE len(t) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        link AS (SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2) p
                 JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * p.k >= 85 * (a.n + b.n - p.k)),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
        SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id
        FROM w JOIN reach r ON r.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id""",
    "op10_quotation_links": r"""
        WITH RECURSIVE b AS (SELECT row_number() OVER () AS id, conv_id AS c, turn AS t, role, coalesce(text, '') AS text FROM conversations),
        m AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t NULLS FIRST, text, id) AS o FROM b),
        l AS (SELECT id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line,
              unnest(range(len(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))))) AS i FROM m),
        k AS (SELECT id, i, line, regexp_extract(line, '^[ \t]*((?:>[ \t]*)+)', 1) AS marks FROM l),
        d AS (SELECT id, i, length(marks) - length(replace(marks, '>', '')) AS depth,
              CASE WHEN marks = '' THEN line ELSE regexp_replace(line, '^[ \t]*((?:>[ \t]*)+)', '') END AS body FROM k),
        r AS (SELECT *, coalesce(depth <> lag(depth) OVER (PARTITION BY id ORDER BY i), false) AS turns FROM d),
        n AS (SELECT *, sum(turns::INT) OVER (PARTITION BY id ORDER BY i) AS place, lower(trim(regexp_replace(body, '[\s\x0B]+', ' ', 'g'))) AS said FROM r),
        p AS (SELECT id, place, any_value(depth) AS depth, string_agg(body, chr(10) ORDER BY i) AS body,
              list_distinct(list(said) FILTER (WHERE said <> '')) AS lines FROM n GROUP BY id, place),
        w AS (SELECT *, lower(trim(regexp_replace(body, '[\s\x0B]+', ' ', 'g'))) AS h FROM p),
        own AS (SELECT DISTINCT m.c, m.o, x.h FROM (SELECT id, h FROM w WHERE depth = 0
              UNION SELECT id, lower(trim(regexp_replace(unnest(string_split_regex(body, '\n[\s\x0B]*\n')), '[\s\x0B]+', ' ', 'g'))) FROM w WHERE depth = 0
              UNION SELECT id, said FROM n WHERE depth = 0) x JOIN m USING (id) WHERE x.h <> ''),
        held AS (SELECT m.c, m.o, list_distinct(list(n.said)) AS lines FROM n JOIN m USING (id) WHERE n.depth = 0 AND n.said <> '' GROUP BY ALL),
        q AS (SELECT m.c, m.o, w.* FROM w JOIN m USING (id) WHERE w.depth > 0 AND w.h <> ''),
        f AS (SELECT q.*, (SELECT min(own.o) FROM own WHERE own.c IS NOT DISTINCT FROM q.c AND own.h = q.h AND own.o < q.o) AS first FROM q),
        s AS (SELECT f.*, coalesce(first, (SELECT min(held.o) FROM held WHERE held.c IS NOT DISTINCT FROM f.c AND held.o < f.o AND list_has_all(held.lines, f.lines))) AS source FROM f),
        a AS (SELECT c, o, arg_min(source, depth * 1000000 + place) AS up, count(*) AS n_linked FROM s WHERE source IS NOT NULL GROUP BY c, o),
        e AS (SELECT m.*, a.up, a.n_linked FROM m LEFT JOIN a ON a.c IS NOT DISTINCT FROM m.c AND a.o = m.o),
        v AS (SELECT id, c, o, 0 AS depth, [o] AS path FROM e WHERE up IS NULL
              UNION ALL SELECT e.id, e.c, e.o, v.depth + 1, list_append(v.path, e.o) FROM v JOIN e ON e.c IS NOT DISTINCT FROM v.c AND e.up = v.o),
        z AS (SELECT id, string_agg(body, chr(10) ORDER BY place) FILTER (WHERE depth = 0) AS content, count(*) FILTER (WHERE depth > 0) AS n_quoted FROM p GROUP BY id)
        SELECT e.c AS conv_id, e.t AS turn, e.role, g.t AS parent_turn, v.depth::INT AS depth, (row_number() OVER (PARTITION BY e.c ORDER BY v.path) - 1)::BIGINT AS position,
               regexp_replace(coalesce(z.content, ''), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS content, z.n_quoted::BIGINT AS n_quoted, coalesce(e.n_linked, 0)::BIGINT AS n_linked
        FROM e JOIN v USING (id) JOIN z USING (id) LEFT JOIN e g ON g.c IS NOT DISTINCT FROM e.c AND g.o = e.up""",
    "op12_name_automaton": f"""
        WITH RECURSIVE ids AS (SELECT client_id AS k FROM clients UNION SELECT vendor_id FROM vendors), h AS (SELECT * FROM {_CRC}),
        c AS (SELECT client_id, name, length(name) AS m, h.crc FROM clients LEFT JOIN h ON h.k = client_id WHERE name <> ''),
        s AS (SELECT DISTINCT vendor_id, name, length(name) AS size, coalesce(h.crc, 1) AS crc FROM vendors LEFT JOIN h ON h.k = vendor_id WHERE name <> ''),
        v AS (SELECT vendor_id, size, CASE WHEN crc % 2 = 1 OR size < 2 THEN name ELSE substr(name, 1, (crc % (size - 1))::INT) || substr(name, (crc % (size - 1))::INT + 2, 1)
              || substr(name, (crc % (size - 1))::INT + 1, 1) || substr(name, (crc % (size - 1))::INT + 3) END AS name FROM s),
        p AS (SELECT v.vendor_id, v.name AS a, c.name AS b, v.size AS l, c.m, c.client_id, c.crc,
                     list_filter(range(1, greatest(v.size, c.m) + 1), lambda i: substr(v.name, i::INT, 1) <> substr(c.name, i::INT, 1)) AS off
              FROM v JOIN c ON abs(c.m - v.size) <= 1),
        d AS (SELECT *, CASE WHEN a = b THEN 0 WHEN l = m AND len(off) = 1 THEN 1
                 WHEN l = m AND len(off) = 2 AND off[2] = off[1] + 1 AND substr(a, off[1]::INT, 1) = substr(b, off[2]::INT, 1) AND substr(a, off[2]::INT, 1) = substr(b, off[1]::INT, 1) THEN 1
                 WHEN l = m + 1 AND substr(a, 1, off[1]::INT - 1) || substr(a, off[1]::INT + 1) = b THEN 1
                 WHEN m = l + 1 AND substr(b, 1, off[1]::INT - 1) || substr(b, off[1]::INT + 1) = a THEN 1 END AS distance FROM p)
        SELECT vendor_id, distance::INT AS distance, count(*) AS n_clients, min(client_id) AS first_client_id, sum(crc)::BIGINT AS clients_crc
        FROM d WHERE distance IS NOT NULL GROUP BY 1, 2""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE d AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
        f AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
              || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
              || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
              coalesce(octet_length(encode(text)) || ':' || text, '-') AS body, coalesce(octet_length(encode(low)) || ':' || low, '-') AS lowered FROM d),
        l AS (SELECT id, doc_id, lang, sha256(head || body) AS leaf, sha256(head || lowered) AS other FROM f),
        s AS (SELECT l.*, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
        ids AS (SELECT DISTINCT doc_id AS k FROM documents), c AS (SELECT k AS doc_id, k IS NOT NULL AND crc % 3 = 0 AS touched FROM {_CRC}),
        node AS (SELECT 0 AS k, lang, i, n, leaf AS h FROM s
                 UNION ALL SELECT k + 1, lang, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY k, lang, i // 8),
        side AS (SELECT k, lang, i, n, coalesce(string_agg(h, '' ORDER BY i) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
                 coalesce(string_agg(h, '' ORDER BY i) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM node WHERE n > 1 WINDOW w AS (PARTITION BY k, lang, i // 8 ORDER BY i)),
        sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
        tnode AS (SELECT 0 AS k, i, n, subroot AS h FROM sub
                 UNION ALL SELECT k + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM tnode WHERE n > 1 GROUP BY k, i // 8),
        tside AS (SELECT k, i, n, coalesce(string_agg(h, '' ORDER BY i) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
                 coalesce(string_agg(h, '' ORDER BY i) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM tnode WHERE n > 1 WINDOW w AS (PARTITION BY k, i // 8 ORDER BY i)),
        up AS (SELECT s.id, s.doc_id, s.leaf, s.lang, 0 AS k, s.i, s.n, CASE WHEN c.touched THEN s.other ELSE s.leaf END AS h, '' AS proof FROM s JOIN c ON c.doc_id IS NOT DISTINCT FROM s.doc_id
               UNION ALL SELECT u.id, u.doc_id, u.leaf, u.lang, u.k + 1, u.i // 8, (u.n + 7) // 8, sha256(x.b || u.h || x.a), u.proof || x.b || x.a
               FROM up u JOIN side x ON x.lang IS NOT DISTINCT FROM u.lang AND x.k = u.k AND x.i = u.i),
        far AS (SELECT u.id, u.doc_id, u.leaf, sub.subroot, 0 AS k, sub.i, sub.n, u.h, u.proof FROM up u JOIN sub ON sub.lang IS NOT DISTINCT FROM u.lang WHERE u.n = 1
               UNION ALL SELECT u.id, u.doc_id, u.leaf, u.subroot, u.k + 1, u.i // 8, (u.n + 7) // 8, sha256(x.b || u.h || x.a), u.proof || x.b || x.a
               FROM far u JOIN tside x ON x.k = u.k AND x.i = u.i)
        SELECT u.doc_id, u.leaf, u.subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.h AS folded_root, u.h = r.h AS verified
        FROM far u, (SELECT h FROM tnode WHERE n = 1) r WHERE u.n = 1""",
}
