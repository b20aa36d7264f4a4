"""SQL (DuckDB) for the rows of the queries that SQL can express, built from the operators' own parameters."""

from __future__ import annotations

from ephemera.llm import license_scan, quality_rules, url_filter

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rounds(kind: str, seeds: str, links: str, rounds: int = url_filter.ROUNDS) -> str:
    """CTEs <kind>_0 .. <kind>_n of a personalised PageRank; ``seeds`` selects node and n."""
    out = [
        f"{kind}_n AS ({seeds})",
        f"{kind}_s AS (SELECT node, n / (SELECT sum(n) FROM {kind}_n) AS share FROM {kind}_n)",
        f"{kind}_p AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM {links})",
        f"{kind}_0 AS (SELECT node, share AS score FROM {kind}_s)",
    ]
    for k in range(rounds):
        out.append(f"{kind}_m{k} AS MATERIALIZED (SELECT dst AS node, {url_filter.DAMPING} * sum(score * p) AS got FROM {kind}_{k} JOIN {kind}_p ON node = src GROUP BY dst)")
        out.append(
            f"{kind}_{k + 1} AS MATERIALIZED (SELECT node, sum(got) AS score FROM (SELECT * FROM {kind}_m{k} UNION ALL "
            f"SELECT node, share * (1 - coalesce((SELECT sum(got) FROM {kind}_m{k}), 0)) FROM {kind}_s) GROUP BY node)"
        )
    return ",\n".join(out)


def trade_ranks_sql(rounds: int = url_filter.ROUNDS) -> str:
    """PageRank over the graph of parts and suppliers, from the suppliers of nation 1."""
    return f"""WITH e AS (SELECT CASE WHEN l_linenumber % 2 = 1 THEN concat('p', l_partkey) ELSE concat('s', l_suppkey) END AS src, CASE WHEN l_linenumber % 2 = 1 THEN concat('s', l_suppkey) ELSE concat('p', l_partkey) END AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL),
{_rounds("r", "SELECT concat('s', s_suppkey) AS node, 1 AS n FROM supplier WHERE s_nationkey = 1", "e", rounds)}
SELECT node, round(score, 9) AS score FROM r_{rounds}"""


def url_filters_sql() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0]) - len(r[1]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in rules]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, rules, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, rules, strict=True))
    link = url_filter.LINK.replace("'", "''")
    n = url_filter.ROUNDS
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    host = _FOLD.format("regexp_extract(rest, '^[^/?#]*')")
    site = lambda c: f"regexp_replace(regexp_extract(regexp_replace({c}, '^(?:[^@]*@)+', ''), '^[^:\\[\\]]*'), '[.,;!]+\\z', '')"
    registry = f"regexp_matches(b, '^(?:{'|'.join(url_filter.REGISTRIES)})\\.[a-z]{{2}}\\z') OR b IN ({', '.join(f"'{x}'" for x in url_filter.SHARED)})"
    seeds = lambda kind: f"SELECT host AS node, {kind} AS n FROM hosts WHERE 2 * {kind} > pages"
    some = lambda t: f"CASE WHEN {t}.score >= {url_filter.LEAST} / (SELECT count(*) FROM hosts) THEN {t}.score ELSE 0 END"
    return f"""WITH r AS (SELECT page_id, html, {rest} AS rest FROM pages),
j AS (SELECT page_id, html, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
v AS (SELECT *, {site("host")} AS site, CASE {rule} END AS rule, CASE {verdict} END AS said FROM j),
hosts AS (SELECT site AS host, count(*) AS pages, count(*) FILTER (said = 'allow') AS allowed, count(*) FILTER (said = 'block') AS blocked FROM v WHERE site <> '' GROUP BY 1),
h AS (SELECT site AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM v),
hl AS (SELECT src, {site(_FOLD.format("dst"))} AS dst, 1e0 AS weight FROM h),
l AS (SELECT * FROM hl WHERE src <> '' AND dst <> '' AND src <> dst),
lab AS (SELECT string_split(host, '.') AS p FROM (SELECT host FROM hosts UNION SELECT dst FROM l) WHERE NOT regexp_matches(host, '^[0-9.]+\\z')),
up AS (SELECT * FROM (SELECT DISTINCT array_to_string(p[k:], '.') AS a, array_to_string(p[k + 1:], '.') AS b FROM (SELECT p, unnest(range(1, len(p) - 1)) AS k FROM lab)) WHERE NOT ({registry})),
fwd AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM l UNION ALL SELECT a, b, {url_filter.PARENT} FROM up WHERE a <> '' AND b <> '' UNION ALL SELECT b, a, {url_filter.PARENT} FROM up WHERE a <> '' AND b <> '') GROUP BY ALL),
bwd AS (SELECT dst AS src, src AS dst, weight FROM fwd),
{_rounds("allowed", seeds("allowed"), "fwd")},
{_rounds("blocked", seeds("blocked"), "bwd")},
s AS (SELECT v.*, coalesce({some("a")}, 0) AS trust, coalesce({some("b")}, 0) AS distrust FROM v LEFT JOIN allowed_{n} a ON a.node = site LEFT JOIN blocked_{n} b ON b.node = site)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN distrust > 0 AND distrust >= {url_filter.DISTRUST} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict FROM s"""


def contamination_sql(n: int = 13) -> str:
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    words = f"regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{word}')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, len, array_to_string(w[k:k + len - 1], ' ') AS s FROM (SELECT item, w, least({n}, len(w)) AS len, unnest(range(1, greatest(1, len(w) - {n} + 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len FROM bw),
dw AS (SELECT doc_id, len, k, array_to_string(w[k:k + len - 1], ' ') AS s FROM (SELECT doc_id, w, len, unnest(range(1, len(w) - len + 2)) AS k FROM d, sizes WHERE len(w) >= len)),
m AS (SELECT doc_id, item, k, dw.len FROM dw JOIN bw USING (len, s)),
h AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT doc_id, k, unnest(range(0, len)) AS j FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""


def jaccard_join_sql(n: int = 5) -> str:
    """Shingles as rows, pairs counted by shared shingles, components by following links; for tables of a few thousand texts."""
    words = f"list_filter(regexp_split_to_array({_FOLD.format("coalesce(text, '')")}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + {n} - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {n} + 1) + 1)) AS k FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * o >= 75 * (ca.n + cb.n - o)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM r GROUP BY 1), links AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id LEFT JOIN links ON links.a = d.doc_id"""


def quality_rules_sql() -> str:
    space, tests = "[ \\t\\n\\x0b\\f\\r]", f"(SELECT count(DISTINCT stratum) * {sum(map(len, quality_rules.GRID.values()))} FROM known)"
    values = {
        "symbol_share": "n_symbols / greatest(word_chars, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)",
        "upper_share": "n_upper / greatest(word_chars, 1)", "same_word_share": "1 - n_distinct / greatest(n_words, 1)", "mark_share": "n_marks / greatest(word_chars, 1)",
    }
    cells = " UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{k}' AS signal, {v} AS value FROM b" for k, v in values.items())
    grid = ", ".join(f"('{k}', {c}::DOUBLE)" for k, cuts in quality_rules.GRID.items() for c in cuts)
    share = quality_rules.RISK / len(quality_rules.GRID)
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share}))"
    return f"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) AS lines, array_to_string(w, '') AS j FROM t),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) s(k) WHERE c > 1 GROUP BY 1),
m AS (SELECT doc_id, stratum, len(w) AS n_words, length(j) AS word_chars, length(regexp_replace(j, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
 length(regexp_replace(j, '[^A-Z]', '', 'g')) AS n_upper, len(list_distinct(w)) AS n_distinct, length(regexp_replace(j, '[^!?*|#<>$%&=~^_{{}}\\[\\]]', '', 'g')) AS n_marks, coalesce(n_repeat_words, 0) AS n_repeat_words FROM l LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
c AS ({cells}),
known AS (SELECT c.*, quality FROM c JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IN (0, 1)),
grid(signal, cut) AS (VALUES {grid}),
n AS (SELECT stratum, signal, cut, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 0) AS n_bad, count(*) FILTER (quality = 1 AND value > cut) AS k, count(*) FILTER (quality = 0 AND value > cut) AS hits FROM known JOIN grid USING (signal) GROUP BY ALL),
s AS (SELECT * FROM n WHERE hits > 0 AND k < n * {share} AND (SELECT sum({term}) FROM range(0, k + 1) x(i)) <= {quality_rules.LEVEL} / {tests}),
best AS (SELECT stratum, signal, cut FROM s QUALIFY row_number() OVER (PARTITION BY stratum, signal ORDER BY hits / n_bad - 5 * k / n DESC, cut DESC) = 1),
bad AS (SELECT DISTINCT doc_id FROM c JOIN best USING (stratum, signal) WHERE value > cut)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept FROM b LEFT JOIN bad ON b.doc_id = bad.doc_id"""


def license_scans_sql() -> str:
    templates = ", ".join(f"('{k}', '{v}')" for k, v in license_scan.TEMPLATES.items())
    size = len(license_scan.TEMPLATES)
    tokens = f"list_filter(regexp_split_to_array({_FOLD}, '[^a-z0-9]+'), lambda x: x <> '')"
    header = "(?i)licen[sc]e|copyright|public domain|all rights reserved|redistribution"

    def cosines(name: str, source: str, key: str) -> str:
        return f"""{name}_t AS (SELECT {key}, token, count(*) AS tf FROM (SELECT {key}, unnest({tokens.format("line")}) AS token FROM {source}) GROUP BY ALL),
{name}_w AS (SELECT {key}, token, tf * coalesce(idf, ln(1.0 + {size}) + 1) AS w FROM {name}_t LEFT JOIN (SELECT DISTINCT token, idf FROM weights) USING (token)),
{name}_n AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM {name}_w GROUP BY ALL),
{name} AS (SELECT {key}, license, sum(w * weight) / any_value(norm) AS cosine FROM {name}_w JOIN weights USING (token) JOIN {name}_n USING ({key}) GROUP BY {key}, license)"""

    return f"""WITH templates(license, text) AS (VALUES {templates}),
tt AS (SELECT license, token, count(*) AS tf FROM (SELECT license, unnest({tokens.format("text")}) AS token FROM templates) GROUP BY ALL),
ti AS (SELECT *, ln((1.0 + {size}) / (1.0 + count(*) OVER (PARTITION BY token))) + 1 AS idf FROM tt),
weights AS (SELECT license, token, idf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY license)) AS weight FROM ti),
f AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, concat_ws('/', source, lang) AS own, text FROM documents),
li AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM f) WHERE regexp_matches(line, '{header}') AND length(line) <= {license_scan.MAX_HEADER}),
{cosines("hc", "li", "doc_id, line")},
best AS (SELECT doc_id, license, round(cosine, 9) AS c FROM hc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(cosine, 9) DESC, license) = 1),
own AS (SELECT * FROM best WHERE c >= {license_scan.THRESHOLD}),
sh AS (SELECT doc_id, text AS line FROM f WHERE doc_id IN (SELECT doc_id FROM own) AND length(text) <= {10 * license_scan.MAX_HEADER}),
{cosines("wc", "sh", "doc_id")},
whole AS (SELECT DISTINCT doc_id FROM wc WHERE cosine >= {license_scan.WHOLE}),
fo AS (SELECT own AS folder, license, count(*) AS n FROM f JOIN own USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM whole) GROUP BY ALL),
fb AS (SELECT folder, license AS theirs FROM fo QUALIFY row_number() OVER (PARTITION BY folder ORDER BY n DESC, license) = 1),
up AS (SELECT own, unnest(range(0, len(string_split(own, '/')) + 1)) AS depth FROM (SELECT DISTINCT own FROM f)),
ne AS (SELECT up.own, theirs FROM up JOIN fb ON folder = array_to_string(string_split(up.own, '/')[1:depth], '/') QUALIFY row_number() OVER (PARTITION BY up.own ORDER BY depth DESC) = 1)
SELECT f.doc_id, path, coalesce(license, theirs) AS license, round(c, 6) AS cosine, CASE WHEN license IS NOT NULL THEN 'header' WHEN theirs IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN ne ON f.own = ne.own"""
