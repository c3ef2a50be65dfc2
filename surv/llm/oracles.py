"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations


def crc32(codes: str) -> str:
    """The crc32 of a list of byte values, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), [0::BIGINT FOR j IN range(8)]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bits}), 4294967295::BIGINT)"


def merkle_manifest(levels: int = 16) -> str:
    """The manifest level by level; ``levels`` must hold 3 ** levels leaves a source and as many sources."""
    fld = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{t}"))
    digits = "CAST(doc_id AS VARCHAR)"
    crc = crc32(f"list_transform(range(1, length({digits}) + 1), lambda i: ascii(substr({digits}, i, 1))::BIGINT)")
    sql = [f"""WITH l0 AS (SELECT doc_id, source, sha256({fld.format(t="text")}) AS leaf,
  CASE WHEN {crc} % 2 = 0 THEN sha256({fld.format(t="replace(text, chr(10), '')")}) END AS new FROM documents),
p0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l0),
n0 AS (SELECT source, pos, leaf AS h FROM p0),
f0 AS (SELECT *, coalesce(new, leaf) AS folded, '' AS proof, pos AS spot FROM p0)"""]
    step = """{n}{j} AS MATERIALIZED (SELECT {k}, pos // 3 AS pos, CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY {k}) AS c FROM {n}{i}) GROUP BY {k}, pos // 3),
{f}{j} AS MATERIALIZED (SELECT f.* EXCLUDE (folded, proof, spot), spot // 3 AS spot, CASE WHEN s.c = 1 THEN folded ELSE sha256(s.l || folded || s.r) END AS folded,
  CASE WHEN s.c = 1 THEN proof ELSE proof || s.l || s.r END AS proof
  FROM {f}{i} f JOIN (SELECT {k} AS k, pos, count(*) OVER (PARTITION BY {k}) AS c,
    coalesce(string_agg(h, '') OVER (PARTITION BY {k}, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY {k}, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {n}{i}) s
  ON f.spot = s.pos AND f.{k} IS NOT DISTINCT FROM s.k)"""
    sql += [step.format(n="n", f="f", k="source", i=i, j=i + 1) for i in range(levels)]
    sql.append(f"""u0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, h, source FROM n{levels}),
m0 AS (SELECT one, pos, h FROM u0),
g0 AS (SELECT f.* EXCLUDE (spot), u.h AS subroot, u.one, u.pos AS spot FROM f{levels} f JOIN u0 u ON f.source IS NOT DISTINCT FROM u.source)""")
    sql += [step.format(n="m", f="g", k="one", i=i, j=i + 1) for i in range(levels)]
    return ",\n".join(sql) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM g{levels} CROSS JOIN (SELECT h FROM m{levels})"""


def spelling_variants() -> str:
    """Words, the pairs one edit apart (by what is left without a symbol), forms and roots."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    byte = "CASE WHEN u < 128 THEN [u::BIGINT] ELSE [195::BIGINT, (u - 64)::BIGINT] END"
    codes = f"flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform([unicode(substr(k, i, 1))], lambda u: {byte})[1]))"
    return f"""WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT *, {crc32(codes)} AS h FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k FROM runs)),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS key FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.key = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.key = b.word),
best AS (SELECT word, count(*) AS n_near, min((-m, other)) AS top FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top[1] >= 10 * w.n THEN top[2] END AS form, CASE WHEN -top[1] >= 10 * w.n THEN -top[1] END AS form_n
  FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL SELECT s.word, f.form, s.step + 1 FROM steps s JOIN formed f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(root, step) AS root FROM steps GROUP BY word) USING (word)"""
