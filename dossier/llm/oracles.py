"""DuckDB SQL of the iterative operators: a common table for each step of each round."""

from __future__ import annotations


def _finite(scale: int) -> str:
    return f"""SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v, row_number() OVER () AS nth FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _distance(a: str, b: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))), 0) AS BIGINT)"


def _round(k: int, keys: str) -> str:
    """Assign rows of p to the entries of c{k}, and the entries of the next round. keys: what tells the codebooks apart."""
    on = "TRUE" if not keys else f"p.{keys} = c.{keys}"
    by = f"{keys}, " if keys else ""
    same = f"m.{keys} = c.{keys} AND " if keys else ""
    listed = f"c.{keys}, " if keys else ""
    own = f"p.{keys}, " if keys else ""
    return f""", a{k} AS MATERIALIZED (
  SELECT p.nth, {own}arg_min(c.entry, {{'d': {_distance("p.v", "c.v")}, 'e': c.entry}}) AS entry, min({_distance("p.v", "c.v")}) AS d
  FROM p JOIN c{k} c ON {on} GROUP BY p.nth{", p." + keys if keys else ""}
), m{k} AS MATERIALIZED (
  SELECT {by}entry, list(mean ORDER BY i) AS v FROM (
    SELECT {own}a.entry, i, CAST(floor(sum(p.v[i]) / count(*)) AS BIGINT) AS mean
    FROM p JOIN a{k} a ON p.nth = a.nth{" AND p." + keys + " = a." + keys if keys else ""}, range(1, len(p.v) + 1) AS t(i) GROUP BY {own}a.entry, i
  ) GROUP BY {by}entry
), c{k + 1} AS MATERIALIZED (SELECT {listed}c.entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON {same}m.entry = c.entry)"""


def ball_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """For vectors of one length."""
    return f"""
WITH e AS MATERIALIZED ({_finite(scale)}), p AS MATERIALIZED (
  SELECT nth, part, v[len(v) * part // {parts} + 1 : len(v) * (part + 1) // {parts}] AS v FROM e, range({parts}) AS t(part)
), f AS (SELECT nth, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM e QUALIFY entry < {entries}
), c0 AS MATERIALIZED (SELECT p.part, f.entry, p.v FROM p JOIN f ON p.nth = f.nth){"".join(_round(k, "part") for k in range(rounds + 1))}
, r AS (SELECT nth, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY nth
), s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM c{rounds})
SELECT e.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY e.label) AS BIGINT) AS label_error, s.h AS codebooks_sha256 FROM e JOIN r ON e.nth = r.nth, s
"""


def subvectors(centroids: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, salt: str = "2:") -> str:
    return f"""
WITH p AS MATERIALIZED (SELECT * FROM ({_finite(scale)}) WHERE len(v) = {dim}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{salt}' || CAST(vec_id AS VARCHAR)), v) - 1 AS entry, v FROM p WHERE vec_id IS NOT NULL QUALIFY entry < {centroids}
){"".join(_round(k, "") for k in range(rounds + 1))}
SELECT p.vec_id, CAST(a.entry AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.entry) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN p ON a.nth = p.nth JOIN c{rounds} c ON c.entry = a.entry
"""


def host_rules(rules: dict[str, str], base: tuple[str, ...], limit: float, strongest: float, weakest: float, window: int = 5) -> str:
    word = r"[^\x20\x09-\x0D]+"
    counts = ", ".join(f"count(*) FILTER ({c}) AS {r}" for r, c in rules.items())
    sums = ", ".join(f"sum({r}) AS {r}, CAST(sum(CAST(CAST({r} AS DOUBLE) * {r} / documents AS DECIMAL(38,6))) AS DOUBLE) AS {r}_shares" for r in rules)

    def rate(r: str) -> str:
        p = f"(CAST(s.{r} AS DOUBLE) / s.documents)"
        room = "(s.documents - s.squares / s.documents - (s.hosts - 1))"
        share = f"(((s.{r}_shares - CAST(s.{r} AS DOUBLE) * s.{r} / s.documents) / nullif({p} * (1 - {p}), 0) - (s.hosts - 1)) / nullif({room}, 0))"
        strength = f"(CASE WHEN {p} IN (0, 1) OR {room} <= 0 OR {share} <= 0 THEN {strongest} ELSE least({strongest}, greatest({weakest}, 1 / {share} - 1)) END)"
        return f"({strength} * {p} + h.{r}) / ({strength} + h.documents)"

    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS nth, doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS words FROM documents
), w AS (
  SELECT nth, pos, array_to_string(words[pos : pos + {window - 1}], ' ') AS gram FROM d, range(1, len(words) - {window - 2}) AS t(pos)
), g AS (
  SELECT nth, pos FROM (SELECT nth, pos, count(*) OVER (PARTITION BY nth, gram) AS n FROM w) WHERE n > 1
), n AS MATERIALIZED (
  SELECT nth, count(DISTINCT pos + k) AS n FROM g, range({window}) AS t(k) GROUP BY nth
), l AS MATERIALIZED (
  SELECT nth, count(*) AS n, count(DISTINCT line) AS different FROM (SELECT nth, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{word}') GROUP BY nth
), m AS MATERIALIZED (
  SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n - l.different, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n, 0) AS n_lines
  FROM d LEFT JOIN n ON d.nth = n.nth LEFT JOIN l ON d.nth = l.nth
), h AS MATERIALIZED (SELECT host, count(*) AS documents, {counts} FROM m GROUP BY host
), s AS MATERIALIZED (SELECT count(*) AS hosts, sum(documents) AS documents, CAST(sum(CAST(documents AS HUGEINT) * documents) AS DOUBLE) AS squares, {sums} FROM h
), v AS (SELECT h.host, {" OR ".join(f"({rate(r)} > {limit})" for r in rules)} AS failed FROM h, s
), j AS (SELECT m.*, {" OR ".join(f"({rules[r]})" for r in base)} AS base_failed, v.failed AS host_failed FROM m JOIN v ON m.host IS NOT DISTINCT FROM v.host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, NOT base_failed AND NOT host_failed AS kept FROM j
"""
