"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import METRICS

WORDS = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quality() -> str:
    shift = "greatest(length(bin(v)) - 6, 0)"
    of = {"word_length": "100 * word_chars // greatest(n_words, 1)", "symbols": "1000 * n_symbols // greatest(n_words, 1)", "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)", "repeat_words": "1000 * n_repeat_words // greatest(n_words, 1)"}
    rows = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS metric, ({v})::BIGINT AS v FROM b WHERE NOT base_failed" for m, v in of.items())
    slack = "CASE metric " + " ".join(f"WHEN '{m}' THEN {a}" for m, (a, _) in METRICS.items()) + " END"
    low = "CASE metric " + " ".join(f"WHEN '{m}' THEN {'q1 - 3.0 * (q3 - q1) - ' + str(x) if x is not None else '-1.0'}" for m, (_, x) in METRICS.items()) + " END"

    def fence(name: str, by: list[str]) -> str:
        keys, on = "".join(f"{k}, " for k in by), "".join(f"{k}, " for k in by) + "metric"
        return f""", {name}_c AS (SELECT {keys}metric, bucket, sum(n) AS n FROM sk GROUP BY {keys}metric, bucket),
{name}_w AS (SELECT *, sum(n) OVER (PARTITION BY {on} ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY {on}) AS al FROM {name}_c),
{name}_q AS (SELECT {keys}metric, max(al) AS n_docs, min(top) FILTER (4 * cum >= al) AS q1, min(top) FILTER (4 * cum >= 3 * al) AS q3
 FROM (SELECT *, ((bucket - s * 32 + 1) << s::INT) - 1 AS top FROM (SELECT *, greatest((bucket - 32) // 32, 0) AS s FROM {name}_w)) GROUP BY {keys}metric),
{name} AS (SELECT {keys}metric, n_docs, q3 + 3.0 * (q3 - q1) + {slack} AS hi, {low} AS lo FROM {name}_q)"""

    return (
        rf"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
f AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS l, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
v AS ({rows}),
sk AS (SELECT lang, source, metric, {shift} * 32 + (v >> {shift}::INT) AS bucket, count(*) AS n FROM v GROUP BY 1, 2, 3, 4)"""
        + fence("own", ["lang", "source"])
        + fence("bylang", ["lang"])
        + fence("whole", [])
        + """, ok AS (SELECT v.doc_id, bool_and(v.v >= CASE WHEN own.n_docs >= 50 THEN own.lo WHEN bylang.n_docs >= 50 THEN bylang.lo ELSE whole.lo END
  AND v.v <= CASE WHEN own.n_docs >= 50 THEN own.hi WHEN bylang.n_docs >= 50 THEN bylang.hi ELSE whole.hi END) AS ok
 FROM v JOIN own ON v.metric = own.metric AND v.lang IS NOT DISTINCT FROM own.lang AND v.source IS NOT DISTINCT FROM own.source
 JOIN bylang ON v.metric = bylang.metric AND v.lang IS NOT DISTINCT FROM bylang.lang JOIN whole ON v.metric = whole.metric GROUP BY v.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, true) AS kept FROM b LEFT JOIN ok USING (doc_id)"""
    )


def _phrases() -> str:
    cuts = " UNION ALL ".join(f"SELECT c.lang, c.g, {k} AS k, c.a, l.a AS l, r.a AS r, (1000000 * c.a::HUGEINT * c.a // (l.a::HUGEINT * r.a))::BIGINT AS s FROM c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:{k}] JOIN f r ON r.lang = c.lang AND r.g = c.g[{k + 1}:] WHERE len(c.g) > {k}" for k in (1, 2))
    grams = " UNION ALL ".join(f"SELECT lang, [{', '.join(f'w{i}' for i in range(m))}] AS g, count(*) AS a FROM y" + f" WHERE w{m - 1} IS NOT NULL GROUP BY ALL" for m in (1, 2, 3))
    return rf"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
y AS (SELECT lang, w AS w0, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM (SELECT lang, id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT *, row_number() OVER () AS id FROM p)) WINDOW o AS (PARTITION BY id ORDER BY i)),
f AS ({grams}),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE len(g) > 1 AND a >= 10),
x AS (SELECT lang, g, max(a) AS most FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, a FROM c WHERE len(g) = 3) GROUP BY lang, g),
b AS (SELECT lang, g, arg_min(struct_pack(a, l, r, s), s * 4 + k) AS v FROM ({cuts}) GROUP BY lang, g),
r AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, v.a AS a, v.l AS l, v.r AS r, v.s AS score FROM b LEFT JOIN x ON x.lang = b.lang AND x.g = b.g WHERE most IS NULL OR 100 * most < 50 * v.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM r)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000"""


def _manifest(levels: int = 8, tops: int = 4) -> str:
    """The trie level by level: up to 8^levels rows of a language and 8^tops languages."""
    fld = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(fld(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
    ctes = [
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS k, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(LOWER_OR_NULL)} END AS bent FROM documents)",
        "e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "n0 AS (SELECT k, i, leaf AS h, count(*) OVER (PARTITION BY k) AS n FROM e)",
    ]

    def climb(a: str, by: str, last: int) -> None:
        for j in range(last):
            ctes.append(f"{a}l{j} AS (SELECT k, i // 8 AS q, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {a}n{j} GROUP BY k, i // 8)".replace("k,", f"{by},").replace("GROUP BY k", f"GROUP BY {by}"))
            ctes.append(f"{a}n{j + 1} AS (SELECT {by}, q AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 7) // 8 AS n FROM {a}l{j})")

    climb("", "k", levels)
    ctes.append(f"tn0 AS (SELECT 0 AS z, row_number() OVER (ORDER BY k) - 1 AS i, h, count(*) OVER () AS n, k FROM n{levels})")
    climb("t", "z", tops)
    joins, steps, proof = "", [], []
    for a, by, own, place, last in (("", "k", "e.k", "e.i", levels), ("t", "z", "0", "t.i", tops)):
        if a:
            joins += " JOIN tn0 t ON t.k = e.k"
        for j in range(last):
            x, pos = f"{a}x{j}", f"(({place} // {8**j}) % 8)::INT"
            joins += f" JOIN {a}l{j} {x} ON {x}.{by} = {own} AND {x}.q = {place} // {8 ** (j + 1)}"
            steps.append((f"{x}.n", f"array_to_string({x}.hs[1 : {pos}], '')", f"array_to_string({x}.hs[{pos} + 2 :], '')"))
    at = "coalesce(bent, leaf)"
    flat = ", ".join(f"{n} AS n_{i}, {a} AS a_{i}, {b} AS b_{i}" for i, (n, a, b) in enumerate(steps))
    ctes.append(f"f0 AS (SELECT doc_id, leaf, n{levels}.h AS subroot, tn{tops}.h AS root, {at} AS node, {flat} FROM e{joins} JOIN n{levels} ON n{levels}.k = e.k CROSS JOIN tn{tops})")
    for i in range(len(steps)):
        proof.append(f"CASE WHEN n_{i} = 1 THEN '' ELSE a_{i} || b_{i} END")
        ctes.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN n_{i} = 1 THEN node ELSE sha256(a_{i} || node || b_{i}) END AS node) FROM f{i})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, sha256({' || '.join(proof)}) AS proof_sha256, node AS folded_root, node = root AS verified FROM f{len(steps)}"


LOWER_OR_NULL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_quality": _quality(),
    "op4_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 5""",
    "op7_near_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
 ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
c AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT c.doc_id, l.b FROM c JOIN l ON c.c = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept FROM s JOIN (SELECT doc_id, min(c) AS m FROM c GROUP BY doc_id) USING (doc_id)""",
    "op11_phrases": _phrases(),
    "op13_manifest": _manifest(),
    "op9_lines": rf"""WITH x AS (SELECT DISTINCT doc_id, source, unnest(string_split(text, chr(10))) AS l FROM documents),
p AS (SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 5),
k AS (SELECT x.source, l FROM x JOIN p ON x.source IS NOT DISTINCT FROM p.source WHERE regexp_matches(l, '{WORDS}') GROUP BY x.source, l, p.n HAVING count(*) >= 5 AND count(*) > p.n * 0.08::DOUBLE),
b AS (SELECT source, list(l) AS ls FROM k GROUP BY source)
SELECT doc_id, CASE WHEN ls IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda t: NOT list_contains(ls, t)), chr(10)) END AS text, lang, d.source, n_chars
FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source""",
}
