"""Registered queries of this package, with reference SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align_tokens, bpe, licenses, lines, merkle, minhash, mixing, ordermin, quality, rules, secret_scan, topk, warc
from .common import LOWER, UPPER, table
from .license_rules import REACH


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from two thirds of the labels."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document."""
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best others of every twentieth vector."""
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("id") % 20 == 0, 20)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents by shingles of four words."""
    return minhash.cluster(table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as counts and digests."""
    rank_file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), rank_file, public_tokenizers.PATTERN)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return ordermin.compare(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that came before."""
    rows = lines.dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents interleaved by source, at weights in proportion to the square roots of the sources' sizes."""
    documents = table(spark, sf_dir, "documents")
    mixed = mixing.mix(documents, mixing.shares_by_size(documents))
    return mixed.select("doc_id", "source", *(f"mix_{c}" for c in ("block", "slot", "release", "deadline", "start")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written into WARC archives and read back."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a manifest by language, and whether a tampered row is found out."""
    documents = table(spark, sf_dir, "documents")
    doc_id, n_chars = documents["doc_id"], documents["n_chars"]
    leaf = lambda size: merkle.leaf_of(doc_id, documents["source"], documents["lang"], size, documents["text"])
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0
    tampered = F.when(chosen, F.unhex(leaf(n_chars.cast("decimal(20,0)") + 1)))
    rows = merkle.manifest(documents, leaf(n_chars), "doc_id", "lang", {"doc_id": doc_id, "tampered": tampered}).proofs()
    given = F.coalesce(merkle.as_text(F.col("tampered")), F.col("leaf"))
    rows = rows.withColumns({"proof_sha256": merkle.siblings_digest(F.col("proof")), "folded_root": merkle.folded(given, F.col("proof"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers: groups, links, and how often linked ids meet in the corpus."""
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    alignment = align_tokens.align(table(spark, sf_dir, "documents"), *files)
    rows = align_tokens.scored(alignment, align_tokens.pair_counts(alignment))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by fixed rules and by a list learned from two thirds of the labels."""
    rows = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "held_out")


QUERIES = {q.__name__: q for q in (op1_quality, op2_licenses, op3_topk, op4_near_dedup, op5_byte_bpe, op6_fingerprints, op7_line_dedup, op8_mixing, op9_secrets, op10_warc, op11_merkle, op12_token_alignment, op13_quality_rules)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SECRET_RULES = ", ".join(f"({n}, {_quoted(r.kind)}, {_quoted(r.regex)}, {r.group}, {r.least}, {r.base})" for n, r in enumerate(secret_scan.RULES))

_LICENSE_RULES = ", ".join(
    f"({n}, {_quoted(word)}, {r.priority}, {_quoted(r.label)}, {_quoted(f'^(?:{r.regex}) ')}, {r.base})"
    for n, r in enumerate(licenses.rules())
    for word in r.keywords
)

SQL = {
    "op4_near_dedup": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, [w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+') IF w <> ''] AS ws FROM documents
        ), i AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 3))) AS k FROM d WHERE len(ws) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 3], ' ') AS shingle FROM i),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id)
        SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept
        FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
        h AS (SELECT *, [CAST('0x' || substr(sha1(t), 5 * g + 1, 5) AS BIGINT) FOR g IN range(8)] AS bits FROM p)
        SELECT page_id, strlen(t) AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((bits[c // 4 + 1] >> (15 - 5 * (c % 4))) & 31 AS INTEGER) + 1, 1) FOR c IN range(32)], '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM h
    """,
    "op8_mixing": f"""
        WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s, text, length(coalesce(text, '')) AS chars, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
        z AS (SELECT s, sqrt(greatest(1, sum(chars))) AS w FROM d GROUP BY s),
        y AS (SELECT min(w) AS least, sum(w ORDER BY s) AS total FROM z),
        x AS (SELECT min(whole) AS whole FROM (SELECT {mixing.PERIOD}::BIGINT << k AS whole FROM range(40) r(k)), y
              WHERE whole * least / total >= {mixing.LEAST} OR 2 * whole > {mixing.MAX_PERIOD}),
        c AS (SELECT s, CAST(greatest(1, floor(whole * w / total + 0.5)) AS BIGINT) AS share FROM z, y, x),
        p AS (SELECT list(share ORDER BY s) AS cs, list(s ORDER BY s) AS names, CAST(sum(share) AS BIGINT) AS period FROM c),
        e(t, done, pick) AS (
            SELECT CAST(-1 AS BIGINT), [CAST(0 AS BIGINT) FOR x IN cs], CAST(0 AS BIGINT) FROM p
            UNION ALL
            SELECT t + 1, [done[i] + CASE WHEN i = best THEN 1 ELSE 0 END FOR i IN range(1, len(done) + 1)], best
            FROM (
                SELECT t, done, CAST(list_position(k, list_min(k)) AS BIGINT) AS best
                FROM (
                    SELECT t, done, period, [CASE WHEN done[i] < cs[i] AND (done[i] * period) // cs[i] <= t + 1
                                     THEN ((done[i] + 1) * period + cs[i] - 1) // cs[i] ELSE 1000000000000 END FOR i IN range(1, len(cs) + 1)] AS k
                    FROM e, p WHERE t + 1 < period
                )
            )
        ),
        slots AS (SELECT names[pick] AS s, done[pick] - 1 AS turn, t AS slot FROM e, p WHERE t >= 0),
        o AS (SELECT *, coalesce(CAST(sum(chars) OVER (PARTITION BY s ORDER BY h, doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM d),
        b AS (SELECT *, start // {mixing.BLOCK_CHARS} AS block FROM o)
        SELECT doc_id, source, block AS mix_block, (block // share) * period + slot AS mix_slot,
               (block // share) * period + (turn * period) // share AS mix_release,
               (block // share) * period + ((turn + 1) * period + share - 1) // share AS mix_deadline, start AS mix_start
        FROM b JOIN c ON b.s = c.s JOIN slots ON slots.s = b.s AND slots.turn = block % share, p
    """,
    "op7_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS raws FROM documents),
        l AS (SELECT doc_id, unnest(generate_series(1, len(raws))) AS k, raws FROM d),
        x AS (SELECT doc_id, k, raws[k] AS raw, trim(raws[k], ' ') AS line FROM l),
        w AS (SELECT *, len(string_split(line, ' ')) AS n FROM x),
        u AS (SELECT line, n, min((doc_id, k)) AS pos FROM w WHERE line <> '' GROUP BY line, n),
        v AS (
            SELECT line, n, pos, i, list_concat(string_split(line, ' ')[1:i - 1], string_split(line, ' ')[i + 1:]) AS rest
            FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM u WHERE n >= {lines.NEAR_WORDS})
        ), gone AS (
            SELECT line FROM (SELECT line, pos, min(pos) OVER (PARTITION BY n, i, rest) AS first FROM v) WHERE first < pos
            UNION SELECT v.line FROM v JOIN u ON array_to_string(v.rest, ' ') = u.line AND u.n = v.n - 1 AND u.n >= {lines.NEAR_WORDS} AND u.pos < v.pos
            UNION SELECT u.line FROM v JOIN u ON array_to_string(v.rest, ' ') = u.line AND u.n = v.n - 1 AND u.n >= {lines.NEAR_WORDS} AND v.pos < u.pos
        ), s AS (
            SELECT w.*, w.line = '' OR (u.pos = (w.doc_id, w.k) AND g.line IS NULL) AS stays
            FROM w LEFT JOIN u ON w.line = u.line LEFT JOIN gone g ON w.line = g.line
        ), t AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, coalesce(string_agg(raw, chr(10) ORDER BY k) FILTER (stays), '') AS text
            FROM s GROUP BY doc_id
        )
        SELECT doc_id, n_lines, n_dropped, length(text) AS n_chars, sha256(text) AS text_sha256 FROM t
    """,
    "op2_licenses": f"""
        WITH rules(rule, word, priority, label, regex, base) AS (VALUES {_LICENSE_RULES}),
        d AS (
            SELECT doc_id, list_filter_empty AS words FROM (
                SELECT doc_id, [w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{licenses.BETWEEN}') IF w <> ''] AS list_filter_empty
                FROM documents)
        ), a AS (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS i FROM d),
        h AS (
            SELECT doc_id, i - 1 AS start, rule, priority, label, base,
                   regexp_extract(array_to_string(words[i:i + {REACH - 1}], ' ') || ' ', regex) AS m
            FROM a JOIN rules ON word = words[i]
        ), f AS (SELECT *, start + length(m) - length(replace(m, ' ', '')) AS stop FROM h WHERE m <> ''),
        k AS (
            SELECT *, coalesce(CASE priority WHEN 1 THEN max(stop) FILTER (priority <= 1) OVER w WHEN 2 THEN max(stop) FILTER (priority <= 2) OVER w
                   ELSE max(stop) OVER w END, -1) AS reach
            FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY start, stop DESC, priority, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), e AS (
            SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                   array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
                   array_to_string(list_sort(list_distinct(list(label) FILTER (base OR reach < stop))), ',') AS labels,
                   max(CASE priority WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END) FILTER (reach < stop) AS score
            FROM k GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
        FROM d LEFT JOIN e ON d.doc_id = e.doc_id
    """,
    "op9_secrets": f"""
        WITH rules(rank, kind, regex, grp, least, base) AS (VALUES {_SECRET_RULES}),
        d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS (
            SELECT doc_id, rank, kind, base, least, regexp_split_to_array(t, regex) AS before,
                   regexp_extract_all(t, regex, 0) AS found,
                   CASE grp WHEN 2 THEN regexp_extract_all(t, regex, 2) WHEN 1 THEN regexp_extract_all(t, regex, 1) ELSE regexp_extract_all(t, regex, 0) END AS part
            FROM d, rules WHERE regexp_matches(t, regex)
        ), u AS (SELECT *, unnest(generate_series(1, len(found))) AS i FROM m),
        s AS (
            SELECT doc_id, rank, kind, base, length(found[i]) AS size,
                   CAST(list_sum([length(x) FOR x IN before[1:i]]) + coalesce(list_sum([length(x) FOR x IN found[1:i - 1]]), 0) AS BIGINT) AS start
            FROM u WHERE length(part[i]) >= least
        ), e AS (
            SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                   count(*) FILTER (kind = 'hex') AS n_hex,
                   coalesce(string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank) FILTER (base), '') AS own,
                   string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank) AS spans
            FROM s GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN e ON d.doc_id = e.doc_id
    """,
    "op11_merkle": """
        WITH RECURSIVE v AS (
            SELECT doc_id, coalesce('k' || lang, '') AS key, n_chars,
                   list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
                               lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc,
                   coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                   coalesce(strlen(text) || ':' || text, '-') AS tail
            FROM documents
        ), r AS (
            SELECT doc_id, key, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n,
                   sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
                   CASE WHEN xor(crc, 4294967295) % 7 = 0
                        THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS tampered
            FROM v
        ), t(key, level, pos, n, h) AS (
            SELECT key, 0, pos, n, leaf FROM r
            UNION ALL
            SELECT key, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY key, level, pos // 2, n
        ), s AS (
            SELECT key, h, level AS height, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1
        ), u(level, pos, n, h) AS (
            SELECT 0, pos, n, h FROM s
            UNION ALL
            SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 2, n
        ), steps AS (
            SELECT r.doc_id, r.key, a.level, (r.pos >> a.level) % 2 AS slot, coalesce(b.h, '') AS other
            FROM r JOIN t a ON a.key = r.key AND a.n > 1 AND a.pos = r.pos >> a.level LEFT JOIN t b ON b.key = a.key AND b.level = a.level AND b.pos = xor(a.pos, 1)
            UNION ALL
            SELECT r.doc_id, r.key, s.height + a.level, (s.pos >> a.level) % 2, coalesce(b.h, '')
            FROM r JOIN s ON s.key = r.key JOIN u a ON a.n > 1 AND a.pos = s.pos >> a.level LEFT JOIN u b ON b.level = a.level AND b.pos = xor(a.pos, 1)
        ), p AS (
            SELECT doc_id, key, list({'slot': slot, 'other': other, 'own': ''} ORDER BY level) AS proof, string_agg(other, '' ORDER BY level) AS others FROM steps GROUP BY doc_id, key
        ), e AS (
            SELECT r.doc_id, r.leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(others, '')) AS proof_sha256,
                   list_reduce(list_concat([{'slot': 0, 'other': '', 'own': coalesce(tampered, leaf)}], coalesce(proof, [])),
                               lambda a, b: {'slot': 0, 'other': '', 'own': sha256(CASE b.slot WHEN 0 THEN a.own || b.other ELSE b.other || a.own END)}).own AS folded_root
            FROM r JOIN s ON s.key = r.key LEFT JOIN p ON p.doc_id IS NOT DISTINCT FROM r.doc_id AND p.key = r.key
        )
        SELECT *, folded_root = root AS verified FROM e
    """,
    "op3_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
            FROM embeddings
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.w, c.w)]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
