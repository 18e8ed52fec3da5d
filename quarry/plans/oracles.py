"""The SQL of the registered queries, for an engine with the test tables as views."""

FILES = """files as (select concat_ws('/', source, lang, case when doc_id % 3 = 0 then 'd' || doc_id || '/main.py' when doc_id % 3 = 1 then 'cmd/doc_' || doc_id || '.go'
  else 'doc_' || doc_id || '.txt' end) as path, lang, text as content, n_chars as size, doc_id as mtime from documents)"""
NAMED = f"""{FILES}, named as (select *, regexp_extract(path, '([^/]*)$', 1) as base, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from files)"""
LINES = f"""{NAMED}, parts as (select path, lang, string_split(content, chr(10)) as p from files),
lines as (select path, lang, unnest(p) as text, generate_subscripts(p, 1) as line from parts)"""
SYMBOLS = rf"""{LINES}, found as (select path, lang, line, case when regexp_extract(text, '^([A-Z][a-z]+)\. ', 1) <> '' then struct_pack(type := 'class', name := regexp_extract(text, '^([A-Z][a-z]+)\. ', 1))
  when regexp_extract(text, '^([A-Z][a-z]+), ', 1) <> '' then struct_pack(type := 'method', name := regexp_extract(text, '^([A-Z][a-z]+), ', 1))
  when regexp_extract(text, '^([A-Z][a-z]+) [a-z]+ [a-z]+\.', 1) <> '' then struct_pack(type := 'variable', name := regexp_extract(text, '^([A-Z][a-z]+) [a-z]+ [a-z]+\.', 1))
  when regexp_extract(text, '^([A-Z][a-z]+) ', 1) <> '' then struct_pack(type := 'function', name := regexp_extract(text, '^([A-Z][a-z]+) ', 1)) end as s from lines),
everything as (select path, lang, line, s.type as type, s.name as name from found where s is not null),
ranked as (select *, row_number() over (partition by path order by case when type = 'class' then 0 else 1 end, line) as r from everything),
symbols as (select path, lang, line, type, name from ranked where r <= 100),
exports as (select distinct path, name from everything where type in ('class', 'method', 'function')),
imports as (select distinct path, regexp_extract(text, '\. ([A-Z][a-z]+)[ .,]', 1) as module from lines where regexp_extract(text, '\. ([A-Z][a-z]+)[ .,]', 1) <> '')"""
EDGES = f"""{SYMBOLS}, offers as (select distinct name as key, path as dst from exports union select regexp_replace(base, '\\.[^.]*$', ''), path from named),
keys as (select distinct key from offers),
edges as (select distinct i.path as src, o.dst from imports i join offers o on o.key = case when i.module in (select key from keys) then i.module else regexp_extract(i.module, '([^.]*)$', 1) end where o.dst <> i.path)"""
DIRS = f"""{NAMED}, by_lang as (select dir, lang, count(*) as n, sum(size) as size from named group by all),
dirs as (select dir, sum(n)::bigint as file_count, sum(size)::bigint as total_size, string_agg(lang || ':' || n, ',' order by lang) as languages from by_lang group by dir)"""
PARTS = """part_paths as (select p_partkey as partkey, replace(p_brand, '#', '') || '/s' || p_size || '/p' || p_partkey || '.py' as path from part)"""


def pairs() -> str:
    return """(select distinct s, t from (select l_partkey as s, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as t from lineitem) where t is not null and s <> t)"""


def import_pairs() -> str:
    return f"(select a.path as src, c.path as dst from {pairs()} e join part_paths a on a.partkey = e.s join part_paths c on c.partkey = e.t)"


def counts() -> str:
    return f"(select dst as path, count(distinct src) as n from {import_pairs()} group by dst)"


COMMITS = f"""{PARTS}, commits as (select o_orderkey::varchar as hash, substr(o_orderkey::varchar, 1, 7) as short, o_orderdate as date_ts, 'author' || (o_custkey % 50) as author,
  o_orderpriority as message, o_orderstatus as body from orders),
commit_files as (select l_orderkey::varchar as hash, path, min(l_returnflag) as status from lineitem join part_paths on partkey = l_partkey group by all),
part_symbols as (select distinct path, 'S' || l_suppkey as name from lineitem join part_paths on partkey = l_partkey),
diff_lines as (select l_orderkey::varchar as hash, path, case when l_linenumber % 2 = 0 then '-' else '+' end as sign, l_returnflag || '_' || l_linestatus || '_' || l_returnflag as text
  from lineitem join part_paths on partkey = l_partkey)"""
NEWEST = "order by date_ts desc, hash"


def picked(symbol: str, n: int) -> str:
    return f"""hits as (select hash, path, (case when sign = '+' then 1 else -1 end) * (length(text) - length(replace(text, '{symbol}', ''))) as n, sign || substr(text, 1, 119) as shown
  from diff_lines where contains(text, '{symbol}')),
by_file as (select hash, path, list(shown) as shown from hits group by all having sum(n) <> 0),
by_commit as (select hash, string_agg(path, ',' order by path) as files, array_to_string(list_sort(flatten(list(shown))), ',') as diff_lines from by_file group by hash),
picked as (select c.*, files, diff_lines from commits c join by_commit using (hash) {NEWEST} limit {n})"""


def year(name: str, where: str) -> str:
    return f"""{name}_l as (select l.*, path from lineitem l join part_paths on partkey = l_partkey where {where}),
{name} as (select path, sum(trunc(l_quantity)::bigint)::bigint as size, count(*)::int as lines from {name}_l group by path),
{name}_s as (select path, list_sort(list(distinct l_returnflag || ':S' || l_suppkey)) as s from {name}_l group by path),
{name}_i as (select path, list_sort(list(distinct l_linestatus || trunc(l_quantity % 7)::int)) as i from {name}_l group by path),
{name}_f as (select * from {name} left join {name}_s using (path) left join {name}_i using (path)),
{name}_out as (select src as path, count(*) as n from {import_pairs()} group by src), {name}_in as (select dst as path, count(*) as n from {import_pairs()} group by dst)"""


CHANGES = f"""{PARTS}, {year("early", "year(l_shipdate) <= 1995")}, {year("late", "year(l_shipdate) >= 1995 and l_partkey % 11 <> 0")},
met as (select coalesce(b.path, t.path) as path, b.path is null as fresh, t.path is null as gone, t.size - b.size as size_delta, t.lines - b.lines as lines_delta,
  list_filter(coalesce(t.s, []), lambda x: not list_contains(coalesce(b.s, []), x)) as sa, list_filter(coalesce(b.s, []), lambda x: not list_contains(coalesce(t.s, []), x)) as sr,
  list_filter(coalesce(t.i, []), lambda x: not list_contains(coalesce(b.i, []), x)) as ia, list_filter(coalesce(b.i, []), lambda x: not list_contains(coalesce(t.i, []), x)) as ir
  from early_f b full join late_f t on b.path = t.path),
changes as (select *, case when fresh then 'added' when gone then 'deleted' when abs(size_delta) > 50 or len(sa) + len(sr) + len(ia) + len(ir) > 0 then 'modified' else 'unchanged' end as change from met)"""


def graph() -> str:
    return f"""nations as (select -1 - n_nationkey::bigint as id, 'r' || n_regionkey || '/' || lower(n_name) || '.py' as file_path, n_nationkey as home from nation),
nodes as (select id, 'file' as type, file_path as name, file_path, 0 as line, null::bigint as parent_id from nations union all
  select p_partkey, ['function', 'method', 'class'][p_partkey % 3 + 1], replace(p_name, ' ', '_'), file_path, (p_partkey % 500)::int, id from part join nations on home = p_partkey % 25 union all
  select -1000 - c_custkey, 'function', lower(replace(c_name, '#', '_')), file_path, (c_custkey % 500)::int, id from customer join nations on home = c_nationkey),
calls as (select s as src_id, t as dst_id from {pairs()} union all select distinct -1000 - o_custkey, l_partkey from orders join lineitem on l_orderkey = o_orderkey)"""


DEAD = "select id, name, file_path, line, type from nodes where type in ('function', 'method') and id not in (select dst_id from calls)"


def reach(edges: str, depth: int, least: int) -> str:
    return f"""with recursive {PARTS}, e as materialized (select distinct src, dst from {edges}), start as (select path from part_paths where partkey = 1),
r(node, dist) as (select path, 0 from start union select e.dst, r.dist + 1 from r join e on e.src = r.node where r.dist < {depth})
select {"(select path from start) as start, node, min(dist)::int as dist" if not least else "node as path, min(dist)::int as dist"} from r group by node having min(dist) >= {least}"""


SQL = {
    "hotspots": f"""with {COMMITS}, chosen as (select * from commits {NEWEST} limit 500),
      rows as (select f.path, c.*, row_number() over (partition by f.path order by date_ts desc, hash) as r from commit_files f join chosen c using (hash))
      select path, count(*) as changes, coalesce(any_value(d.n), 0) as dependent_count, count(*) + coalesce(any_value(d.n), 0) as score, string_agg(short, ',' order by r) filter (r <= 3) as recent_commits,
      string_agg(message, ',' order by r) filter (r <= 3) as recent_messages from rows left join {counts()} d using (path) group by path order by score desc, path limit 20""",
    "path_functions": f"""with {NAMED} select path, base, regexp_extract(base, '(\\.[^.]*)$', 1) as ext, regexp_replace(base, '\\.[^.]*$', '') as stem, dir, split_part(path, '/', 1) as area,
      array_to_string(string_split(dir, '/')[1:2], '/') as dir2, case when base like '%.py' then 'python' when base like '%.go' then 'go' else '-' end as lang,
      case when size * 100 / 1024.0 < 1024 then printf('%.0fKB', size * 100 / 1024.0::double) else printf('%.1fMB', size * 100 / 1024.0::double / 1024) end as label from named""",
    "ignored_paths": f"""with {FILES} select path, path like 'src3/%' or path like '%.txt' as ignored, false as ignored_in_graph from files""",
    "source_files": f"""with {FILES} select path, case when path like '%.py' then 'python' else 'go' end as lang from files where path not like '%.txt'""",
    "file_lines": f"""with {LINES} select path, line, length(text) as n_chars from lines""",
    "index_entries": f"""with {NAMED} select path, base, regexp_replace(base, '\\.[^.]*$', '') as stem, dir, lang, size, (length(content) - length(replace(content, chr(10), '')) + 1)::int as lines, false as truncated from named""",
    "index_symbols": f"with {SYMBOLS} select path, line, type, name from symbols",
    "index_imports": f"with {SYMBOLS} select path, module from imports",
    "index_exports": f"with {SYMBOLS} select path, name from exports",
    "truncated_symbols": f"with {SYMBOLS} select path, line, type, name from ranked where r <= 4",
    "import_graph": f"with {EDGES} select src, dst from edges",
    "entry_points": f"with {NAMED} select path from named where base = 'main.py' or contains('/' || path, '/cmd/')",
    "config_files": f"""with {FILES} select distinct p as path from (select regexp_replace(path, '^src1/en/d[0-9]+/main.py$', 'setup.py') as p from files) where p = 'setup.py'""",
    "dir_stats": f"with {DIRS} select dir, file_count, total_size, languages from dirs",
    "dirs_depth_1": f"""with {NAMED}, k as (select split_part(dir, '/', 1) as d, lang, count(*) as n, sum(size) as size from named group by all)
      select d as dir, sum(n)::bigint as file_count, sum(size)::bigint as total_size, string_agg(lang || ':' || n, ',' order by lang) as languages from k group by d""",
    "dirs_depth_2": f"""with {NAMED}, k as (select array_to_string(string_split(dir, '/')[1:2], '/') as d, lang, count(*) as n, sum(size) as size from named group by all)
      select d as dir, sum(n)::bigint as file_count, sum(size)::bigint as total_size, string_agg(lang || ':' || n, ',' order by lang) as languages from k group by d""",
    "languages": "select lang, count(*) as files from documents group by lang",
    "index_stats": f"""with {EDGES} select (select count(*) from files) as total_files, (select count(*) from symbols) as total_symbols,
      (select count(*) from named where base = 'main.py' or contains('/' || path, '/cmd/')) as entry_point_count, 0::bigint as config_file_count,
      (select count(distinct src) from edges) as files_with_imports, (select count(*) from edges) as import_edge_count""",
    "summary_top": f"""with {NAMED}, k as (select split_part(dir, '/', 1) as d, lang, count(*) as n, sum(size) as size from named group by all), g as (select d as dir, sum(n)::bigint as file_count,
      sum(size) / 1024.0::double as kb, string_agg(lang || ':' || n, ',' order by lang) as languages from k group by d)
      select dir, file_count, case when kb < 1024 then printf('%.0fKB', kb) else printf('%.1fMB', kb / 1024) end as size, languages from g""",
    "symbol_exact": f"with {SYMBOLS} select path, line, type, name from everything where name = 'The'",
    "symbol_part": f"with {SYMBOLS} select path, line, type, name from symbols where contains(lower(name), 'th')",
    "importers": f"with {SYMBOLS} select path, min(module) as module from imports where contains(module, 'er') group by path",
    "files_glob": f"""with {SYMBOLS}, own as (select path, count(*) as n, list(type || ':' || name order by line, type, name)[1:5] as few from symbols group by path)
      select path, lang, coalesce(array_to_string(few, ','), '') as symbols, coalesce(n, 0)::int as n_symbols from files left join own using (path) where regexp_full_match(path, 'src1.*/.*/doc_.*[05]\\.txt')""",
    "files_glob_base": f"""with {SYMBOLS}, own as (select path, count(*) as n, list(type || ':' || name order by line, type, name)[1:5] as few from symbols group by path)
      select path, lang, coalesce(array_to_string(few, ','), '') as symbols, coalesce(n, 0)::int as n_symbols from named left join own using (path) where base = 'main.py'""",
    "search": f"""with {SYMBOLS}, hit as (select path, count(*) as n from symbols where contains(lower(name), 'an') group by path)
      select path, lang, coalesce(n, 0) as n_matches, contains(lower(path), 'an') as path_match, (2 * coalesce(n, 0) + contains(lower(path), 'an')::int)::bigint as score from files left join hit using (path)
      where n > 0 or contains(lower(path), 'an') order by score desc, path limit 50""",
    "search_filtered": f"""with {SYMBOLS}, hit as (select path, count(*) as n, list(name order by line, type, name)[1:5] as few from symbols where contains(lower(name), 'e') and type = 'function' group by path)
      select path, lang, coalesce(n, 0) as n_matches, contains(lower(path), 'e') as path_match, (2 * coalesce(n, 0) + contains(lower(path), 'e')::int)::bigint as score, array_to_string(few, ',') as shown
      from files left join hit using (path) where lang = 'en' and (n > 0 or contains(lower(path), 'e')) order by score desc, path limit 20""",
    "dependents": f"with {PARTS} select src as path from {import_pairs()} where dst = (select path from part_paths where partkey = 1)",
    "dependent_counts": f"with {PARTS} select path, n as dependent_count from {counts()}",
    "dependents_of": f"""with {PARTS}, d as (select dst as path, string_agg(distinct src, ',' order by src) as dependents from {import_pairs()} group by dst)
      select path, coalesce(dependents, '') as dependents from part_paths left join d using (path) where partkey % 100 = 0""",
    "reach_depth_3": reach(import_pairs(), 3, 0),
    "impact_closure": reach(f"(select dst as src, src as dst from {import_pairs()})", 4, 1),
    "recent_commits": f"""with {COMMITS} select hash, short, author, message from commits where date_ts >= timestamp '1995-01-01' and date_ts <= timestamp '1997-06-30' and regexp_matches(author, 'author1')
      and regexp_matches(message, '^[1-3]') {NEWEST} limit 50""",
    "recent_below": f"""with {COMMITS} select hash from commits where hash in (select hash from commit_files where path like 'Brand1/s1/%' or path like 'Brand2/%') {NEWEST} limit 30""",
    "file_history": f"""with {COMMITS} select hash, author from commits where hash in (select hash from commit_files where split_part(path, '/', 1) = 'Brand13') {NEWEST} limit 25""",
    "commit_detail": f"""with {COMMITS}, own as (select hash, string_agg(status || ' ' || path, ',' order by path, status) as files from commit_files where hash like '10%' group by hash)
      select hash, message, body, files from commits left join own using (hash) where hash like '10%'""",
    "recent_impact": f"""with {COMMITS}, chosen as (select * from commits {NEWEST} limit 40), sc as (select path, count(*) as k from part_symbols group by path),
      own as (select f.hash, f.path, coalesce(d.n, 0) as n, coalesce(k, 0) as k from commit_files f join chosen using (hash) left join {counts()} d using (path) left join sc using (path)),
      sums as (select hash, sum(n)::bigint as n, sum(k)::bigint as k, coalesce(string_agg(path, ',' order by path) filter (n >= 5), '') as high from own group by hash),
      ar as (select hash, string_agg(area || ':' || c, ',' order by area) as areas from (select hash, split_part(path, '/', 1) as area, count(*) as c from own group by all) group by hash)
      select hash, coalesce(n, 0) as dependent_count, coalesce(k, 0) as symbol_count, coalesce(high, '') as high_impact_files, coalesce(areas, '') as areas from chosen left join sums using (hash) left join ar using (hash)""",
    "areas": f"with {COMMITS} select hash, split_part(path, '/', 1) as area, count(*) as files from commit_files group by all",
    "area_summary": f"""with {COMMITS} select split_part(path, '/', 1) as area, count(distinct hash) as commits, count(distinct author) as authors, count(distinct path) as files_changed
      from commit_files join commits using (hash) group by 1""",
    "commit_impact": f"""with {COMMITS}, names as (select hash, count(distinct name)::int as k from commit_files join part_symbols using (path) group by hash)
      select hash, count(*) as files, sum(coalesce(n, 0))::bigint as total_dependents, (count(*) + sum(coalesce(n, 0)))::bigint as impact_score, coalesce(any_value(k), 0) as n_symbols
      from commit_files left join {counts()} d using (path) left join names using (hash) group by hash""",
    "impact_files": f"""with {COMMITS}, own as (select distinct path from commit_files where hash like '1%'), d as (select dst as path, count(distinct src)::int as n, list_sort(list(distinct src)) as s from {import_pairs()} group by dst),
      sc as (select path, count(*) as k from part_symbols group by path)
      select path, coalesce(n, 0) as dependent_count, coalesce(array_to_string(s[1:10], ','), '') as dependents, coalesce(k, 0) as symbol_count from own left join d using (path) left join sc using (path)""",
    "pickaxe": f"with {COMMITS}, {picked('N', 40)} select hash, files, diff_lines from picked",
    "trace": f"""with {COMMITS}, {picked('A', 30)}, m as (select hash, string_agg(path || ':' || n, ',' order by path) as impact from by_file join {counts()} d using (path) group by hash)
      select hash, coalesce(impact, '') as impact from picked left join m using (hash)""",
    "search_commits": f"""with {COMMITS}, {picked('O', 30)}, said as (select hash from commits where regexp_matches(message, '(?i)O') {NEWEST} limit 30),
      found as (select hash, min(k) as k from (select hash, 0 as k from said union all select hash, 1 from picked) group by hash),
      top as (select c.*, case k when 0 then 'message' else 'code' end as match_type, row_number() over ({NEWEST}) as r from commits c join found using (hash) {NEWEST} limit 30),
      score as (select hash, sum(coalesce(n, 0))::bigint as impact_score from commit_files join top using (hash) left join {counts()} d using (path) where r <= 20 group by hash)
      select hash, match_type, impact_score from top left join score using (hash)""",
    "diff_changes": f"""with {CHANGES} select path, change, size_delta, lines_delta, array_to_string(sa, ',') as symbols_added, array_to_string(sr, ',') as symbols_removed, array_to_string(ia, ',') as imports_added,
      array_to_string(ir, ',') as imports_removed from changes""",
    "diff_summary": f"""with {CHANGES}, m as (select * from changes where change = 'modified') select (select count(*) from changes where change = 'added') as files_added,
      (select count(*) from changes where change = 'deleted') as files_deleted, (select count(*) from m) as files_modified, (select count(*) from changes where change = 'unchanged') as files_unchanged,
      (select coalesce(sum(len(sa)), 0)::bigint from m) as symbols_added, (select coalesce(sum(len(sr)), 0)::bigint from m) as symbols_removed,
      (select coalesce(sum(least(len(sa), 20)), 0)::bigint from m) as capped_symbols_added, (select coalesce(sum(least(len(sr), 20)), 0)::bigint from m) as capped_symbols_removed""",
    "diff_entries": f"""with {CHANGES} select path, 'added' as change from late where lines >= 8 and path not in (select path from early where lines >= 8)
      union all select path, 'removed' from early where lines >= 8 and path not in (select path from late where lines >= 8)""",
    "diff_high_impact": f"""with {CHANGES}, g as (select path, case when change = 'added' then 0 else coalesce(a.n, 0) end as out_degree_before, coalesce(b.n, 0) as out_degree_after,
      coalesce(c.n, 0) as in_degree_before, coalesce(d.n, 0) as in_degree_after, change = 'added' as new_high_impact from changes left join early_out a using (path) left join late_out b using (path)
      left join early_in c using (path) left join late_in d using (path) where change in ('modified', 'added'))
      select * from g where (not new_high_impact and abs(out_degree_after - out_degree_before) > 2) or (new_high_impact and out_degree_after >= 5)""",
    "diff_most_changed": f"with {CHANGES} select path, (len(sa) + len(sr))::int as symbol_changes from changes where change = 'modified' order by symbol_changes desc, path limit 10",
    "incremental": f"""with {FILES} select path, mtime from files f where not exists (select 1 from (select path, case when mtime % 7 = 0 then 0 else mtime end as m from files where mtime % 5 <> 0) o where o.path = f.path and o.m = f.mtime)""",
    "graph_nodes": f"with {graph()} select id, type, name, file_path, line, parent_id from nodes",
    "graph_stats": f"""with {graph()} select 'nodes' as what, '-' as type, count(*) as count from nodes union all select 'nodes', type, count(*) from nodes group by type
      union all select 'edges', '-', (select count(*) from calls) + (select count(*) from part) + (select count(*) from customer) union all select 'edges', 'CALLS', (select count(*) from calls) union all select 'edges', 'DEFINES', (select count(*) from part) + (select count(*) from customer)
      union all select 'communities', '-', (select count(distinct p_size) from part)""",
    "graph_find": f"""with {graph()} select id, type, name, file_path, line, 'python' as lang from nodes where regexp_matches(lower(name), '(^|[^a-z0-9])red') or regexp_matches(file_path, '(^|[^a-z0-9])red')
      order by file_path, line, name, type, id limit 200""",
    "graph_find_like": f"with {graph()} select id, type, name, file_path, line, 'python' as lang from nodes where name ilike '%idge%' order by file_path, line, name, type, id limit 200",
    "graph_neighbors": f"""with {graph()}, e as (select src_id, dst_id, 'CALLS' as t from calls union all select parent_id, id, 'DEFINES' from nodes where parent_id is not null)
      select e.src_id as id, n.id as node_id, t as edge_type, n.type as node_type, n.name, 'outbound' as direction from e join nodes n on n.id = e.dst_id where e.src_id % 100 = 0
      union all select e.dst_id, n.id, t, n.type, n.name, 'inbound' from e join nodes n on n.id = e.src_id where e.dst_id % 100 = 0""",
    "graph_trace": f"""with recursive {graph()}, e as materialized (select * from calls), r(id, depth) as (select 1::bigint, 0 union select dst_id, depth + 1 from r join e on src_id = r.id where depth < 3)
      select 1::bigint as start, r.id as node_id, min(depth)::int as depth, any_value(name) as name from r join nodes on nodes.id = r.id group by r.id""",
    "graph_dead_code": f"with {graph()} {DEAD} and id not in (select src_id from calls)",
    "graph_no_inbound": f"with {graph()} {DEAD}",
    "graph_communities": f"""with {graph()}, m as (select p_size::bigint as community_id, n.*, row_number() over (partition by p_size order by name, type, n.id) as r from part join nodes n on n.id = p_partkey),
      top as (select community_id, count(*) as size from m group by all order by size desc, community_id limit 10)
      select community_id, any_value(size) as size, substr(string_agg(name, ', ' order by r), 1, 120) as names, string_agg(type || ':' || name, ',' order by r) filter (r <= 5) as sample_nodes from m join top using (community_id) group by community_id""",
    "graph_file_activity": f"with {graph()} select file_path, 0::bigint as out_calls, 0::bigint as in_calls from nations order by file_path limit 10",
    "graph_symbol_activity": f"""with {graph()}, o as (select file_path, count(*) as n from calls join nodes on id = src_id group by 1), i as (select file_path, count(*) as n from calls join nodes on id = dst_id group by 1)
      select file_path, coalesce(o.n, 0) as out_calls, coalesce(i.n, 0) as in_calls from (select distinct file_path from nations) left join o using (file_path) left join i using (file_path) order by out_calls desc, file_path limit 10""",
    "import_targets": f"""with {NAMED}, asked as (select distinct module from (select lower(unnest(regexp_split_to_array(text, '[ \\n]+'))) as module from benchmark union all select 'x.' || replace(p_brand, 'Brand#', 'doc_') from part) where length(module) > 1),
      one as (select module, min(path) as dst from asked join named on contains(path, module) group by module),
      two as (select module, min(path) as dst from asked join named on base = regexp_extract(module, '([^/]*)$', 1) or regexp_replace(base, '\\.[^.]*$', '') = regexp_extract(module, '([^/]*)$', 1) group by module),
      three as (select module, min(path) as dst from asked join named on contains(path, regexp_extract(module, '([^./\\\\]*)$', 1)) group by module)
      select module, coalesce(one.dst, two.dst, three.dst) as dst from asked left join one using (module) left join two using (module) left join three using (module) where coalesce(one.dst, two.dst, three.dst) is not null""",
    "test_edges": """with t as (select distinct replace(p_name, ' ', '_') as v from part), s as (select distinct 'src/' || replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '_') || '.py' as path from part)
      select distinct 'tests/test_' || v || '.py' as test, path from t join s on contains(path, v)""",
    "call_resolution": f"""with occ as (select 'd' || (p_size % 5) || '/' || replace(p_brand, '#', '') || '.py' as path, p_name as name, p_partkey as id from part),
      e as (select * from {pairs()}), calls as (select a.path, case when b.id % 4 = 0 then upper(b.name) else b.name end as name, a.name as caller from e join occ a on a.id = e.s join occ b on b.id = e.t),
      imported as (select distinct src, dst from (select 'd' || (s_suppkey % 5) || '/Brand' || (s_suppkey % 25 + 1) || '.py' as src, 'd' || (s_nationkey % 5) || '/Brand' || (s_nationkey % 25 + 1) || '.py' as dst from supplier)
        where src <> dst and src in (select path from occ)),
      names as (select name, count(*) as n, min((path, id)) as ord from occ group by name), lowest as (select lower(name) as lower, arg_min(name, ord) as other from names group by 1),
      asked as (select distinct c.path, c.name, coalesce(n.name, l.other) as meant from calls c left join names n on n.name = c.name left join lowest l on l.lower = lower(c.name)),
      cand as (select a.path, a.name, o.id, o.path as place, case when exists (select 1 from imported i where i.src = a.path and i.dst = o.path) then 0 when o.path = a.path then 1
        when split_part(o.path, '/', 1) = split_part(a.path, '/', 1) then 2 when n.n = 1 then 3 else 4 end as step from asked a join occ o on o.name = a.meant join names n on n.name = a.meant),
      target as (select path, name, arg_min(id, (step, place, id)) as dst_id, min(step) as step from cand group by all),
      callers as (select path, name as caller, min(id) as src_id from occ group by all)
      select distinct src_id, dst_id, 'CALLS' as type, 0.7::double as confidence, ['imported file', 'same file', 'same directory', 'unique name', 'first'][step + 1] as strategy,
      [0.95, 0.9, 0.85, 0.75, 0.55][step + 1]::double as strategy_confidence from calls join target using (path, name) join callers using (path, caller) where src_id <> dst_id""",
}
