"""SQL for queries p2_, p3_ and p5_ that plain SQL can express, written without the operators' methods."""

from __future__ import annotations

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
# What stands before a name: dots, underscores that begin no mangled name, thunk and import marks. Underscores of _Z are hidden while they go.
_PREFIX = r"replace(regexp_replace(regexp_replace({0}, '_Z(L?[0-9N])', chr(1) || '\1', 'g'), '^(\.|j_|__imp_|thunk_|_)+', ''), chr(1), '_Z')"
# A name that a disassembler made up from an address or a number, whatever a compiler or linker put behind it.
_PLACEHOLDER = r"'^_*(sub|FUN|fcn|fun|loc|locret|nullsub|off|unk|byte|unknown_libname|func|thunk_FUN|case|j_sub)[_.]([0-9A-F]+|[0-9a-f]*[0-9][0-9a-f]*)(_\d+)?(\.[a-z_]+|\.\d+|@+[A-Za-z_][A-Za-z0-9_.]*)*$'"


def name_sql(table: str, out: str, keep: str, column: str = "func_name") -> str:
    """CTEs that end in `out`: the columns `keep` and name, the source-level name of `column`. What is no name at all is taken out first."""
    return rf"""{out}_0 AS (SELECT {keep}, {_PREFIX.format(_TRIM.format(column))} AS b FROM {table}),
    {out}_1 AS (SELECT {keep}, regexp_matches(b, {_PLACEHOLDER}) AS no_name, regexp_replace(b, '(\.(cold|isra|constprop|part|lto_priv|llvm|clone)(\.\d+)*|\.\d+|@plt|@{{1,2}}[A-Za-z_][A-Za-z0-9_.]*)+$', '') AS b FROM {out}_0),
    {out}_2 AS (SELECT {keep}, no_name, CASE WHEN regexp_extract(b, '^_ZL?(\d{{1,4}})', 1) <> '' THEN substr(b, length(regexp_extract(b, '^_ZL?\d{{1,4}}')) + 1, regexp_extract(b, '^_ZL?(\d{{1,4}})', 1)::INT) ELSE b END AS b FROM {out}_1),
    {out}_3 AS (SELECT {keep}, no_name, {_PREFIX.format('b')} AS b FROM {out}_2),
    {out} AS (SELECT {keep}, CASE WHEN no_name OR regexp_matches(b, {_PLACEHOLDER}) THEN NULL ELSE nullif(regexp_replace(b, '_\d{{1,2}}$', ''), '') END AS name FROM {out}_3)"""


_ROWS = rf"""{name_sql('flowchart', 'nm', 'func_id, split_name, hashopcodes, bb_list, start_ea, idb_path')},
    r AS (SELECT func_id, name, lower({_TRIM.format('split_name')}) AS s, regexp_replace(lower({_TRIM.format('hashopcodes')}), '^(sha-?256:|0x)', '') AS h,
        list_distinct(list_transform(list_filter(string_split(bb_list, ';'), lambda x: x <> ''), lambda x: x::BIGINT - start_ea::BIGINT)) AS o, idb_path FROM nm),
    u AS (SELECT func_id, name, CASE WHEN regexp_full_match(h, '[0-9a-f]{{64}}') THEN h END AS digest, o, s IN ('train', 'training') AS train,
        CASE WHEN s IN ('val', 'valid', 'validation', 'dev') THEN 'validation' ELSE 'testing' END AS held,
        'Dataset-' || upper(substr(k, 1, 1)) || substr(k, 2) AS dataset
        FROM (SELECT *, lower(regexp_extract(idb_path, '(?i)[/\\]dataset-(1|2|vulnerability)[/\\]', 1)) AS k FROM r) WHERE len(o) >= 5 AND s IN ('train', 'training', 'val', 'valid', 'validation', 'dev', 'test', 'testing')),
    pairs AS (SELECT t.func_id AS a, x.func_id AS b FROM u t JOIN u x ON t.digest = x.digest WHERE t.train AND NOT x.train
        UNION SELECT t.func_id, x.func_id FROM u t JOIN u x ON t.name = x.name WHERE t.train AND NOT x.train AND len(list_intersect(t.o, x.o)) * 9 >= 4 * (len(t.o) + len(x.o)))"""

_SETS = r"""c AS (SELECT sig_id AS id, false AS known, catalog_hash_list AS l FROM catalog_sigs UNION ALL SELECT sig_id, true, catalog_hash_list FROM vuln_sigs),
    v AS (SELECT DISTINCT id, known, unnest(regexp_extract_all(l, '[0-9]+'))::BIGINT AS x FROM c), n AS (SELECT id, count(*) AS n FROM v GROUP BY id),
    shared AS (SELECT a.id AS i, b.id AS j, count(*) AS k FROM v a JOIN v b ON a.x = b.x AND a.id < b.id AND NOT (a.known AND b.known) GROUP BY ALL),
    w AS (SELECT fss_id AS id, CASE WHEN lower(trim(hashes0)) LIKE '0x%' THEN lower(trim(hashes0))::HUGEINT WHEN trim(hashes0) LIKE '-%' THEN trim(hashes0)::HUGEINT + 18446744073709551616
        WHEN trim(hashes0) <> '' THEN trim(hashes0)::HUGEINT END::UBIGINT AS w FROM fss_hashes)"""

_FOLDED = r"regexp_replace(replace(lower(regexp_replace(idb_path, '^\s+|\s+$', '', 'g')), '\', '/'), '/+', '/', 'g')"
_PROJECTS = rf"""p AS (SELECT func_name, coalesce(nullif(regexp_extract({_FOLDED}, '(^|/)dataset-(1|vulnerability)/([^/]+)/', 3), ''), nullif(regexp_extract({_FOLDED}, '(^|/)dataset-2/[^/_]*_([^/_-]+)-', 2), '')) AS project FROM flowchart),
    {name_sql('p', 'q', 'project')}, {name_sql('runtime_names', 'rt', 'origin')},
    e AS (SELECT DISTINCT project, name FROM q WHERE name NOT IN (SELECT name FROM rt WHERE name IS NOT NULL) AND project IS NOT NULL),
    link AS (SELECT DISTINCT a.project AS a, b.project AS b FROM e a JOIN e b USING (name) WHERE a.project <> b.project),
    reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)"""

_CLASSES = """cls AS (SELECT id, list_sort(list(x)) AS s FROM {0} GROUP BY id), cid AS (SELECT id, min(id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS copies FROM cls)"""
_LINKS = """SELECT c.id, c.class_id, c.copies, count(DISTINCT o.class_id) AS links FROM cid c LEFT JOIN (SELECT i AS a, j AS b FROM near UNION ALL SELECT j, i FROM near) p ON p.a = c.class_id
        LEFT JOIN cid o ON o.id = p.b AND o.class_id <> c.class_id GROUP BY c.id, c.class_id, c.copies"""
# Rows stand for their project, else their name, else themselves; vertices with a name in common are related, and so on; a component is called by its least vertex.
_COMPONENTS = rf"""fp AS (SELECT func_id, func_name, coalesce(nullif(regexp_extract({_FOLDED}, '(^|/)dataset-(1|vulnerability)/([^/]+)/', 3), ''), nullif(regexp_extract({_FOLDED}, '(^|/)dataset-2/[^/_]*_([^/_-]+)-', 2), '')) AS project FROM flowchart),
    {name_sql('fp', 'fn', 'func_id, project')}, {name_sql('runtime_names', 'rt', 'origin')},
    rows AS (SELECT func_id, project, CASE WHEN name NOT IN (SELECT name FROM rt WHERE name IS NOT NULL) THEN name END AS name FROM fn),
    v AS (SELECT func_id, name, coalesce('0:' || project, '1:' || name, 'r:' || func_id) AS vertex FROM rows),
    star AS (SELECT DISTINCT vertex AS a, first_value(vertex) OVER (PARTITION BY name ORDER BY vertex) AS b FROM v WHERE name IS NOT NULL),
    link AS (SELECT a, b FROM star WHERE a <> b UNION SELECT b, a FROM star WHERE a <> b),
    reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
    part AS (SELECT vertex, least(vertex, coalesce(min(b), vertex)) AS component FROM (SELECT DISTINCT vertex FROM v) LEFT JOIN reach ON a = vertex GROUP BY vertex),
    size AS (SELECT component, count(*) AS weight FROM v JOIN part USING (vertex) GROUP BY component),
    run AS (SELECT *, sum(weight) OVER (ORDER BY weight DESC, component) - weight / 2 AS mid, sum(weight) OVER () AS total FROM size),
    one AS (SELECT *, mid < total * 0.7 AS training FROM run), start AS (SELECT coalesce(sum(weight) FILTER (training), 0) AS s FROM one),
    placed AS (SELECT component, CASE WHEN training THEN 'training' WHEN mid < s + (total - s) * 0.5 THEN 'validation' ELSE 'testing' END AS split FROM one, start)"""

SQL = {
    "p3_catalog_links": f"WITH {_SETS}, {_CLASSES.format('v')}, near AS (SELECT i, j FROM (SELECT a.id AS i, b.id AS j, count(*) AS k FROM v a JOIN v b ON a.x = b.x AND a.id < b.id GROUP BY ALL) JOIN n a ON a.id = i JOIN n b ON b.id = j WHERE k * 3 >= a.n + b.n) {_LINKS}",
    "p3_hash_links": f"""WITH {_SETS}, cid AS (SELECT id, min(id) OVER (PARTITION BY w) AS class_id, count(*) OVER (PARTITION BY w) AS copies FROM w WHERE w <> 0),
        near AS (SELECT a.id AS i, b.id AS j FROM w a JOIN w b ON a.id < b.id WHERE a.w <> 0 AND b.w <> 0 AND bit_count(a.w & b.w)::INT * 10 >= 9 * bit_count(a.w | b.w)::INT) {_LINKS}""",
    "p5_splits": f"WITH RECURSIVE {_COMPONENTS} SELECT func_id, component, split FROM v JOIN part USING (vertex) JOIN placed USING (component)",
    "p2_found": f"WITH {_ROWS} SELECT least(a, b) AS func_id_1, greatest(a, b) AS func_id_2 FROM pairs",
    "p2_report": f"""WITH {_ROWS}, d AS (SELECT DISTINCT x.func_id FROM u t JOIN u x ON t.digest = x.digest WHERE t.train AND NOT x.train),
        n AS (SELECT DISTINCT x.func_id FROM u t JOIN u x ON t.name = x.name WHERE t.train AND NOT x.train AND len(list_intersect(t.o, x.o)) * 9 >= 4 * (len(t.o) + len(x.o)))
        SELECT held AS split, dataset, count(*) AS rows_held, count(d.func_id) AS by_digest, count(n.func_id) AS by_name, count(coalesce(d.func_id, n.func_id)) AS overlapping
        FROM u LEFT JOIN d USING (func_id) LEFT JOIN n USING (func_id) WHERE NOT train GROUP BY ALL""",
    "p3_found": f"""WITH {_SETS} SELECT 'catalog_hash_list' AS field, i AS id_1, j AS id_2 FROM shared JOIN n a ON a.id = i JOIN n b ON b.id = j WHERE k * 3 >= a.n + b.n
        UNION ALL SELECT 'hashes0', a.id, b.id FROM w a JOIN w b ON a.id < b.id WHERE a.w <> 0 AND b.w <> 0 AND bit_count(a.w & b.w)::INT * 10 >= 9 * bit_count(a.w | b.w)::INT""",
    "p5_found": f"WITH RECURSIVE {_PROJECTS} SELECT DISTINCT a AS project_1, b AS project_2 FROM reach WHERE a < b",
}
