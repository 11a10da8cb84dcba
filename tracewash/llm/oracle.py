"""DuckDB SQL for the operators that SQL can express, over whole tables.

Written apart from the Spark code, in plain relational form.  Personal data,
the two tokenizers, sharding by propagation, the network score, the Merkle tree
(no checksum of its kind in DuckDB) and whitening (eigenvectors) have none; their
tests hold them against brute-force versions.
"""

from __future__ import annotations

from . import quality, secrets

_BLANKS = r"[\x20\x09-\x0D]+"
_WORDS = lambda text: f"list_filter(string_split_regex({text}, '{_BLANKS}'), lambda x: x <> '')"
_quoted = lambda s: "'" + s.replace("'", "''") + "'"


def _components(node: str, nodes: str) -> str:
    """``comp(node, component_id)`` from ``links(u, v)``, which holds both ways."""
    return f"""reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
        comp AS (SELECT n.{node}, least(n.{node}, min(r.v)) AS component_id FROM {nodes} n LEFT JOIN reach r ON r.u = n.{node} GROUP BY n.{node})"""


VECTORS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL),
    sound AS MATERIALIZED (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM e
        WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
    {_components("vec_id", "e")}
    SELECT vec_id, (SELECT count(*) FROM links WHERE u = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM comp"""

NEAR_DOCUMENTS = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents WHERE doc_id IS NOT NULL),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
    {_components("doc_id", "d")}
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)"""


def _spans(k: int, rule: secrets.Rule) -> str:
    p = _quoted(rule.pattern)
    return f"""SELECT r, {k} AS k, a, a + length(m) AS b FROM (
        SELECT r, m, g, sum(length(p)) OVER (PARTITION BY r ORDER BY i) + coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (
            SELECT r, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(ps[1 : len(ms)]) AS p FROM (
                SELECT r, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {rule.group}) AS gs, string_split_regex(t, {p}) AS ps FROM d WHERE regexp_matches(t, {p})))) WHERE length(g) >= {rule.least}"""


_BASE = [r.kind for r in secrets.BASE]
SECRETS = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    s AS ({" UNION ALL ".join(_spans(k, r) for k, r in enumerate(secrets.RULES))}),
    named AS (SELECT *, [{", ".join(_quoted(r.kind) for r in secrets.RULES)}][k + 1] || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT) AS span FROM s),
    g AS (SELECT r, string_agg(span, ',' ORDER BY a, k, b) AS spans, string_agg(span, ',' ORDER BY a, k, b) FILTER (k < {len(_BASE)}) AS base,
        {", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, kind in enumerate(_BASE))} FROM named GROUP BY r)
    SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in _BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""

MIXING = f"""WITH d AS MATERIALIZED (SELECT doc_id, source, len({_WORDS("coalesce(text, '')")}) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS o FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
    w AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS BIGINT) AS rest, CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS free FROM s
        WINDOW b AS (ORDER BY 3 * source_size / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    first_free AS (SELECT rest, free FROM w WHERE 3 * source_size * free >= rest * weight ORDER BY 3 * source_size / weight, source NULLS FIRST LIMIT 1),
    t AS (SELECT w.source, source_size, weight, CASE WHEN 3 * source_size * w.free < w.rest * weight OR f.free IS NULL THEN CAST(3 * source_size AS DOUBLE)
        ELSE least(CAST(f.rest AS DOUBLE) * weight / f.free, CAST(3 * source_size AS DOUBLE)) END AS target FROM w LEFT JOIN first_free f ON true),
    p AS (SELECT d.doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS goal, (weight - 2) * 0.5::DOUBLE AS slope,
        CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    k AS (SELECT *, list_transform([0, 1, 2], lambda x: greatest(0, least(size, goal - place - x * source_size))) AS passes, least(place / greatest(goal, 1), 1.0::DOUBLE) AS share FROM p)
    SELECT doc_id, size, source_size, target, CAST(list_sum(passes) AS BIGINT) AS taken, CASE WHEN size > 0 THEN len(list_filter(passes, lambda x: 2 * x >= size)) ELSE 1 END AS copies,
        CASE WHEN list_sum(passes) > 0 THEN CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END + 0.0::DOUBLE END AS position FROM k"""


def _stop_words() -> str:
    forms = lambda words: ", ".join(_quoted(f) for w in words.split() for f in dict.fromkeys((w, w.capitalize())))
    return "CASE lang " + " ".join(f"WHEN '{code}' THEN len(list_filter(w, lambda x: x IN ({forms(words)})))" for code, words in quality.STOP_WORDS.items()) + " END"


QUALITY = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {_WORDS("coalesce(text, '')")} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
    g AS (SELECT r, i, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
    twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c > 1),
    rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
    m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, {_stop_words()} AS n_stop, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (r)),
    v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(word_chars / n_words BETWEEN 2 AND 15, true)
        AND coalesce(n_symbols / nullif(word_chars, 0) <= 0.05, true) AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.6, true) AND coalesce(n_stop / nullif(n_words, 0) >= 0.02, true) AS kept FROM v"""

EXACT = f"""WITH d AS MATERIALIZED (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_BLANKS}', ' ', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""

ORACLE_SQL = {
    "op2_vector_near_dedup": VECTORS,
    "op4_secret_scan": SECRETS,
    "op5_minhash_near_dedup": NEAR_DOCUMENTS,
    "op9_source_mixing": MIXING,
    "op10_quality_rules": QUALITY,
    "op11_exact_dedup": EXACT,
}
