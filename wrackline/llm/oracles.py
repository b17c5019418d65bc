"""DuckDB SQL of the queries that SQL can express.

The others rest on hashes, models or a tokenizer that SQL lacks, and are held
against brute-force versions in the tests.
"""

from __future__ import annotations

from wrackline.llm.common import LOWER, UPPER
from wrackline.llm.url_filter import RULES, SOFT, SOFT_LIMIT, STRICT


def _low(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def _listed(terms) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


_RULES = ", ".join(f"('{r}', '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for r, v in RULES)
_WEIGHTS = " + ".join(f"CASE WHEN list_contains(w, '{t}') THEN {x} ELSE 0 END" for t, x in SOFT.items())

_URLS = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
q AS (SELECT page_id, u, {_low("regexp_extract(u, '://([^/?#]*)', 1)")} AS host, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract_all({_low('u')}, '[a-z0-9]+') AS w FROM p),
r AS (SELECT * FROM (VALUES {_RULES}) t(rule, verdict, r_host, r_path)),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS by_rule FROM q JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id),
s AS (SELECT page_id, host, path, len(list_filter(w, lambda x: list_contains({_listed(STRICT)}, x)))::BIGINT AS strict_hits, ({_WEIGHTS})::DOUBLE AS soft_weight FROM q)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN strict_hits > 0 OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_weight
FROM s LEFT JOIN m USING (page_id)"""

_COPIES = f"""
WITH d AS (SELECT doc_id, sha256({_low("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256 FROM d WINDOW g AS (PARTITION BY text_sha256)"""

ORACLE_SQL: dict[str, str] = {"op6_url_filter": _URLS, "op10_exact_dedup": _COPIES}
