"""The registry of the subpackage's queries and their SQL twins."""

from __future__ import annotations

from ..plans.registry import Registry
from .canonical import p2_found
from .encoding import p8_ids
from .language import p10_found, p10_passages
from .leaks import p9_clean, p9_found, p9_passages
from .mojibake import p3_found, p3_repairs
from .neardup import p1_found, p1_groups
from .pii import p7_found, p7_redacted
from .splitting import P5_FOUND, p5_found, p5_pieces

registry = Registry()
registry.add("p1_found", p1_found)
registry.add("p1_groups", p1_groups)
registry.add("p8_ids", p8_ids)
registry.add("p9_found", p9_found)
registry.add("p9_passages", p9_passages)
registry.add("p9_clean", p9_clean)
registry.add("p2_found", p2_found)
registry.add("p5_found", p5_found, P5_FOUND)
registry.add("p5_pieces", p5_pieces)
registry.add("p3_found", p3_found)
registry.add("p3_repairs", p3_repairs)
registry.add("p10_found", p10_found)
registry.add("p10_passages", p10_passages)
registry.add("p7_found", p7_found)
registry.add("p7_redacted", p7_redacted)

# SQL twins, where the problem can be stated by joins on all rows.

_SHINGLES = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
    s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM w WHERE len(w) >= 5)"""
registry.sql["p1_found"] = f"""WITH {_SHINGLES}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
    SELECT a AS doc_id_a, b AS doc_id_b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE i / (x.n + y.n - i) >= 0.55"""

registry.sql["p1_groups"] = f"""WITH RECURSIVE {_SHINGLES}, sets AS (SELECT doc_id, list_sort(list(g)) AS s FROM s GROUP BY 1), cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS c FROM sets),
    k AS (SELECT c, g FROM s JOIN cls USING (doc_id) WHERE doc_id = c), n AS (SELECT c, count(*) AS n FROM k GROUP BY 1),
    i AS (SELECT a.c AS a, b.c AS b, count(*) AS i FROM k a JOIN k b ON a.g = b.g AND a.c <> b.c GROUP BY ALL), e AS (SELECT a, b FROM i JOIN n x ON x.c = a JOIN n y ON y.c = b WHERE i / (x.n + y.n - i) >= 0.55),
    reach AS (SELECT c, c AS r FROM n UNION SELECT reach.c, e.b FROM reach JOIN e ON e.a = reach.r), grp AS (SELECT c, min(r) AS group_id FROM reach GROUP BY 1), deg AS (SELECT a AS c, count(*) AS n_links FROM e GROUP BY 1)
    SELECT doc_id, coalesce(cls.c, doc_id) AS class_id, coalesce(group_id, doc_id) AS group_id, coalesce(n_links, 0) AS n_links FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN cls USING (doc_id) LEFT JOIN grp ON grp.c = cls.c LEFT JOIN deg ON deg.c = cls.c"""

_LEAKS = """g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) AS g
        FROM (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 12),
    h AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) AS g
        FROM (SELECT item_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL) WHERE len(w) >= 12),
    found AS (SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (g))"""
registry.sql["p9_found"] = f"WITH {_LEAKS} SELECT doc_id, item_id FROM found"
registry.sql["p9_clean"] = f"WITH {_LEAKS} SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found)"
