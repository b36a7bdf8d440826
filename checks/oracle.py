"""The same results in plain DuckDB SQL.

Written apart from the library on purpose: imports are resolved by candidate lists, pruning by path
prefixes, the file limit by a running sum, folding by plain windows.
"""
from __future__ import annotations

from packloom import constants as K
from packloom.config import ExportConfig
from packloom.sources import views as V

LIMITS = ExportConfig()

NOW = "timestamp '2024-03-01 12:00:00'"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(expr: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"when {_lit(k)} then {_lit(v)}" for k, v in mapping.items())
    return f"case {expr} {whens} end"


def _any(template: str, values) -> str:
    return "(" + " or ".join(template.format(_lit(v)) for v in values) + ")"


CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql, list(needs))


def sql(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][1]:
            visit(dep)
        order.append(name)

    for name in needs:
        visit(name)
    parts = ",\n".join(
        f"{n} as {'' if n in ('closed', 'jvm_closed', 'jvm_bare') else 'materialized '}({CTES[n][0]})" for n in order
    )
    return f"with recursive {parts}\n{final}" if parts else final


# --- files, directories, selections --------------------------------------------------------------------
EXT = "case when contains(name, '.') then regexp_extract(name, '[^.]*$') end"
STEM = r"case when contains(name, '.') then regexp_replace(name, '\.[^.]*$', '') else name end"
cte("files", f"""
select *, {EXT} as ext, {STEM} as stem,
  coalesce({_case(f"lower({EXT})", K.LANGUAGE_BY_EXTENSION)}, 'UNKNOWN') as language
from (select *, regexp_extract(path, '[^/]*$') as name from ({V.files_sql('duckdb')}) f0) f1""")
FAMILY = (
    "case when language in ('JAVA','KOTLIN') then 'JVM' when language in ('JAVASCRIPT','TYPESCRIPT','JSX','TSX') "
    "then 'SCRIPT' when language in ('PYTHON','HTML','CSS') then language else 'OTHER' end"
)
cte("dirs", """
select distinct repo, array_to_string(list_slice(string_split(dir, '/'), 1, i), '/') as path
from (select distinct repo, dir from files where dir <> '') d,
  lateral (select unnest(generate_series(1, len(string_split(dir, '/')))) as i)""", "files")
cte("nodes", """
select repo, path, name, dir, ext, false as is_dir, size_bytes from files
union all
select repo, path, regexp_extract(path, '[^/]*$') as name,
  case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as dir,
  null as ext, true as is_dir, 0 as size_bytes from dirs""", "files", "dirs")
cte("sel", V.FILE_SELECTIONS_SQL, "files")
cte("walksel", V.WALK_SELECTIONS_SQL, "files")
cte("appsel", V.APP_SELECTIONS_SQL, "files")
cte("sources", f"""
select s.export_id, f.repo, f.path, f.name, f.stem, f.ext, f.dir, f.language, {FAMILY} as family
from sel s join files f using (repo, path)""", "sel", "files")
cte("appsources", f"""
select s.export_id, f.repo, f.path, f.name, f.stem, f.ext, f.dir, f.language, {FAMILY} as family
from appsel s join files f using (repo, path)""", "appsel", "files")

# --- ignore rules --------------------------------------------------------------------------------------
cte("rules", r"""
select repo, gi_dir, rule_no, original, negated, dir_only, starts_with(bare, '/') as rooted,
  regexp_replace(bare, '^/', '') as pattern
from (
  select *, starts_with(original, '!') as negated, ends_with(body, '/') as dir_only, regexp_replace(body, '/$', '') as bare
  from (
    select *, regexp_replace(regexp_replace(original, '^!', ''), '^\\([#!])', '\1') as body
    from (
      select repo, dir as gi_dir, cast(unnest(generate_series(0, len(ls) - 1)) as bigint) as rule_no, trim(unnest(ls)) as original
      from (select repo, dir, string_split_regex(content, '\r\n|\n|\r') as ls from files where name = '.gitignore') x0) x1
    where original <> '' and not starts_with(original, '#')) x2) x3""", "files")
_STARS = "replace(replace(replace(replace({}, '**', chr(1)), '*', '[^/]*'), '?', '[^/]'), chr(1), '.*')"
_GLOB = (
    "(case when not rooted and not starts_with(pattern, '**') and not contains(pattern, '/') then '**/' else '' end "
    "|| pattern || case when dir_only and not ends_with(pattern, '/**') then '/**' else '' end)"
)
_LAST = "regexp_extract(pattern, '[^/]*$')"
_NAME_SRC = f"(case when dir_only then {_LAST} else pattern end)"
_ESC_PATH = r"regexp_replace({}, '([.+()^$|])', '\\\1', 'g')"
_ESC_NAME = r"regexp_replace({}, '([.+()^$|{{}}\[\]])', '\\\1', 'g')"
cte("compiled", f"""
select *,
  case when not simple then '^' || {_STARS.format(_ESC_PATH.format(_GLOB))} || '$' end as path_regex,
  case when not simple and {_NAME_SRC} <> '' and (not contains(pattern, '/') or dir_only)
    then '^' || {_STARS.format(_ESC_NAME.format(_NAME_SRC))} || '$' end as name_regex
from (select *, not regexp_matches(pattern, '[*?\\[{{]') and not dir_only as simple from rules) r0""", "rules")
cte("matches", f"""
select repo, path, gi_dir, gi_depth, rule_no, case when negated then -1 else 1 end as verdict
from (
  select *, case
      when simple then case when rooted or contains(pattern, '/') then rel = pattern else name = pattern end
      when glob_hit then not (dir_only and name = {_LAST} and not is_dir)
      else name_hit and (not dir_only or is_dir) end as hit
  from (
    select *, coalesce(regexp_matches(name, name_regex), false) as name_hit, case
        when dir_only and starts_with(rel, pattern || '/') then true
        when contains(pattern, '/**/*.') and starts_with(rel, split_part(pattern, '/**/*.', 1))
          then ends_with(rel, '.' || regexp_extract(pattern, '[^.]*$'))
        else coalesce(regexp_matches(rel, path_regex), false) end as glob_hit
    from (
      select n.repo, n.path, n.name, n.is_dir, r.gi_dir, r.rule_no, r.negated, r.dir_only, r.rooted, r.pattern,
        r.simple, r.path_regex, r.name_regex,
        case when r.gi_dir = '' then 0 else len(string_split(r.gi_dir, '/')) end as gi_depth,
        case when r.gi_dir = '' then n.path else substr(n.path, length(r.gi_dir) + 2) end as rel
      from nodes n join compiled r on n.repo = r.repo and (r.gi_dir = '' or starts_with(n.path, r.gi_dir || '/'))
    ) m0) m1) m2
where hit""", "nodes", "compiled")
cte("ignored", """
select repo, path, arg_max(verdict, gi_depth * 1000000 + rule_no) = 1 as ignored from matches group by repo, path""", "matches")

# --- walk ------------------------------------------------------------------------------------------------
_BINARY = "(length(substr(content, 1, 1024)) - length(replace(substr(content, 1, 1024), chr(1), '')) > 300)"
cte("bad", f"""
select repo, path from dirs where regexp_extract(path, '[^/]*$') in {_in(K.IGNORED_NAMES)}
union select i.repo, i.path from ignored i join dirs d using (repo, path) where i.ignored""", "dirs", "ignored")
cte("reached", """
select s.export_id, n.repo, n.path, n.name, n.ext, n.is_dir, n.size_bytes, min(s.root_ordinal) as root_ordinal,
  bool_or(s.path = n.path and not s.is_dir) as explicit
from walksel s join nodes n on s.repo = n.repo
  and (s.path = n.path or (s.is_dir and starts_with(n.path, s.path || '/')))
where not exists (select 1 from bad b where b.repo = n.repo and starts_with(n.path, b.path || '/')
  and (b.path = s.path or starts_with(b.path, s.path || '/')))
group by all""", "walksel", "nodes", "bad")


def _walked(name: str, max_kb: int, filters=None) -> None:
    extra = ""
    if filters:
        endings = [f if f.startswith(".") else "." + f for f in filters]
        extra = "when not r.is_dir and not " + _any("ends_with(lower(r.name), lower({}))", endings) + " then 'FILENAME_FILTER' "
    cte(name, f"""
select *, not is_dir and exclusion_reason is null as kept from (
select r.*, coalesce(i.ignored, false) as gitignored, case
  when r.name in {_in(K.IGNORED_NAMES)} then 'IGNORED_NAME'
  when coalesce(i.ignored, false) and not r.explicit then 'GITIGNORE'
  when not r.is_dir and lower(r.ext) in {_in(K.BINARY_EXTENSIONS)} then 'BINARY_CONTENT'
  when not r.is_dir and r.size_bytes > {max_kb} * 1024 then 'SIZE_LIMIT'
  when not r.is_dir and f.bin then 'BINARY_CONTENT'
  {extra} end as exclusion_reason
from reached r left join ignored i on i.repo = r.repo and i.path = r.path
left join (select repo, path, {_BINARY} as bin from files) f on f.repo = r.repo and f.path = r.path) w0""",
        "reached", "ignored", "files")


_walked("walked", LIMITS.max_file_size_kb)
_walked("walkedf", LIMITS.max_file_size_kb, [".ts", "py", "JAVA", "md"])


def _limited(name: str, source: str, n: int) -> None:
    cte(name, f"""
select * from (
  select *, sum(case when kept then 1 else 0 end) over (partition by export_id order by root_ordinal, string_split(path, '/')
    rows between unbounded preceding and 1 preceding) as before from {source}) l0
where coalesce(before, 0) < {n}""", source)


_limited("limited", "walked", LIMITS.file_limit)

# --- rendering --------------------------------------------------------------------------------------------
_HEADERS = {key: prefix for prefix, keys in K.HEADER_KEYS.items() for key in keys}
_PREFIX = (
    f"coalesce({_case('lower(ext)', _HEADERS)}, {_case('name', _HEADERS)}, {_case('lower(name)', _HEADERS)}, "
    f"{_lit(K.DEFAULT_HEADER)})"
)
_HEADER = f"(case when ends_with({_PREFIX}, '-->') then replace({_PREFIX}, '-->', path || ' -->') else {_PREFIX} || path end)"
_HAS = lambda e: (
    "(" + " or ".join(f"starts_with({e}, {_lit(p)})" for p in K.HEADER_KEYS if not p.endswith("-->"))
    + rf" or regexp_matches({e}, '^\s*<!--\s*filename:\s*.*\s*-->'))"
)
_TOKENS = lambda e: f"len(regexp_extract_all({e}, '{K.TOKEN_PATTERN}'))"
cte("numbered", r"""
select repo, path, name, ext, content, array_to_string(list_transform(ls, lambda x, i: lpad(cast(i as varchar), w, ' ') || ': ' || x), chr(10))
  || case when ends_with(content, chr(10)) then chr(10) else '' end as numbered
from (select *, cast(length(cast(len(ls) as varchar)) as integer) as w
  from (select *, string_split_regex(content, '\r\n|\n|\r') as ls from files) n0) n1""", "files")
cte("bodies", f"select *, {_TOKENS('body')} as approx_tokens from (select repo, path, {_HEADER} || chr(10) || numbered as body from numbered) b0", "numbered")
cte("entries", "select l.export_id, b.repo, b.path, b.body, b.approx_tokens from limited l join bodies b using (repo, path) where l.kept", "limited", "bodies")
cte("wide", "select l.export_id, b.repo, b.path, b.body, b.approx_tokens from limited l join bodies b using (repo, path) where l.kept", "limited", "bodies")
_AFTER = lambda e: f"case when contains({e}, chr(10)) then substr({e}, instr({e}, chr(10)) + 1) else {e} end"
cte("stats", f"""
select export_id, substr(split_part(body, chr(10), 1), 14) as path, length(inner_text) as chars, {_TOKENS('inner_text')} as tokens
from (select *, {_AFTER('body')} as inner_text from wide where starts_with(body, '// filename: ')) s0""", "wide")
cte("plain", "select export_id, string_agg(body, chr(10) order by path) as text from entries group by export_id", "entries")


def _tree(name: str, source: str) -> None:
    cte(f"{name}_n", f"""
select distinct export_id, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') as path, i as depth,
  i = len(string_split(path, '/')) as is_file, list_extract(string_split(path, '/'), i) as name,
  array_to_string(list_slice(string_split(path, '/'), 1, i - 1), '/') as parent
from (select distinct export_id, path from {source}) t0, lateral (select unnest(generate_series(1, len(string_split(path, '/')))) as i)""", source)
    cte(f"{name}_l", f"""
select *, row_number() over (partition by export_id, parent order by is_file desc, name desc) = 1 as is_last from {name}_n""", f"{name}_n")
    cte(f"{name}_r", f"""
select n.export_id, n.path, n.name, n.is_file, n.is_last,
  coalesce(string_agg(case when a.is_last then '    ' else '│   ' end, '' order by a.depth) filter (a.path <> n.path), '') as above,
  string_agg((case when a.is_file then '1' else '0' end) || a.name, chr(1) order by a.depth) as key
from {name}_l n join {name}_l a on a.export_id = n.export_id and (a.path = n.path or starts_with(n.path, a.path || '/'))
group by all""", f"{name}_l")
    cte(name, f"""
select export_id, '// Directory structure' || chr(10) || string_agg('// ' || above || case when is_last then '└── ' else '├── ' end
  || name || chr(10), '' order by key) || '// End of directory structure' as text from {name}_r group by export_id""", f"{name}_r")


_tree("tree_wide", "wide")
_tree("tree_entries", "entries")


def _summary(kind: str, source: str, stats: str, url: str) -> str:
    """Summary text of one format over a stats CTE."""
    esc = lambda e: f"replace(replace(replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
    nl = "chr(10)"
    line = f"chars || ' chars | ' || tokens || ' tokens | ' || printf('%.1f', round(pct, 1)) || '%'"
    if kind == "plain":
        item = f"'    ' || path || {nl} || '    ' || {line} || {nl}"
        text = (f"'**Repository Info**' || {nl} || {nl} || 'Repository' || {nl} || '    ' || {url} || {nl} || 'Generated At' || {nl} || '    01.03.2024, 12:00:00' || {nl} "
                f"|| 'Format' || {nl} || '    plain text' || {nl} || {nl} || 'Pack Summary' || {nl} || {nl} || 'Total Files' || {nl} || '    ' || n || ' files' || {nl} "
                f"|| 'Total Size' || {nl} || '    ' || c || ' chars' || {nl} || 'Total Tokens' || {nl} || '    ' || t || ' tokens' || {nl} || {nl} || 'Top 10 Files' || {nl} || {nl} || items || {nl}")
    elif kind == "markdown":
        item = f"'### ' || path || {nl} || {line} || {nl} || {nl}"
        text = (f"'# Repository Info' || {nl} || {nl} || '## Repository' || {nl} || {url} || {nl} || '## Generated At' || {nl} || '01.03.2024, 12:00:00' || {nl} "
                f"|| '## Format' || {nl} || 'markdown' || {nl} || {nl} || '# Pack Summary' || {nl} || {nl} || '## Total Files' || {nl} || n || ' files' || {nl} "
                f"|| '## Total Size' || {nl} || c || ' chars' || {nl} || '## Total Tokens' || {nl} || t || ' tokens' || {nl} || {nl} || '## Top 10 Files' || {nl} || {nl} || items")
    else:
        item = (f"'      <file>' || {nl} || '        <path>' || {esc('path')} || '</path>' || {nl} || '        <chars>' || chars || '</chars>' || {nl} "
                f"|| '        <tokens>' || tokens || '</tokens>' || {nl} || '        <percentage>' || printf('%.1f', round(pct, 1)) || '</percentage>' || {nl} || '      </file>' || {nl}")
        text = (f"'<repository-summary>' || {nl} || '  <repository-info>' || {nl} || '    <repository-url>' || {esc(url)} || '</repository-url>' || {nl} "
                f"|| '    <generated-at>01.03.2024, 12:00:00</generated-at>' || {nl} || '    <format>xml</format>' || {nl} || '  </repository-info>' || {nl} "
                f"|| '  <pack-summary>' || {nl} || '    <total-files>' || n || '</total-files>' || {nl} || '    <total-chars>' || c || '</total-chars>' || {nl} "
                f"|| '    <total-tokens>' || t || '</total-tokens>' || {nl} || '    <top-files>' || {nl} || items || '    </top-files>' || {nl} "
                f"|| '  </pack-summary>' || {nl} || '</repository-summary>' || {nl}")
    return f"""
select e.export_id, '{kind}' as format, {text} as text
from (select export_id, count(*) as n from {source} group by export_id) e
left join (select export_id, string_agg({item}, '' order by rk) as items, max(c) as c, max(t) as t from (
  select *, row_number() over (partition by export_id order by chars desc, path) as rk,
    sum(chars) over (partition by export_id) as c, sum(tokens) over (partition by export_id) as t,
    chars / (sum(chars) over (partition by export_id)) * 100.0 as pct from {stats}) z where rk <= 10 group by export_id) i using (export_id)
left join bestwide u using (export_id)"""


cte("repos", V.REPOS_SQL, "files")
_BEST = """
select export_id, repo, repo_root, url from (
  select s.export_id, r.repo, r.repo_root, r.url, row_number() over (partition by s.export_id order by count(*) desc, r.repo_root, r.url) as rk
  from {} s join repos r on r.repo = s.repo and (s.path = r.repo_root or starts_with(s.path, r.repo_root || '/'))
  group by s.export_id, r.repo, r.repo_root, r.url) b0 where rk = 1"""
cte("bestwide", _BEST.format("wide"), "wide", "repos")
cte("estats", f"""
select export_id, substr(split_part(body, chr(10), 1), 14) as path, length(inner_text) as chars, {_TOKENS('inner_text')} as tokens
from (select *, {_AFTER('body')} as inner_text from entries where starts_with(body, '// filename: ')) s0""", "entries")

# --- imports -----------------------------------------------------------------------------------------------

def _concat_all(pats) -> str:
    out = f"regexp_extract_all(content, {_lit(pats[0])}, 1)"
    for p in pats[1:]:
        out = f"list_concat({out}, regexp_extract_all(content, {_lit(p)}, 1))"
    return out


_EXTRACT = "case family " + " ".join(f"when '{f}' then {_concat_all(p)}" for f, p in K.IMPORT_PATTERNS.items()) + " end"
cte("imports", f"""
select repo, src, dir, language, family, unnest(list_distinct(found)) as import_str from (
  select repo, path as src, dir, language, family, {_EXTRACT} as found
  from (select *, {FAMILY} as family from files) i0 where family <> 'OTHER') i1""", "files")
# Relative references of the corpus climb first and then descend.
_CLIMB = r"(length(regexp_extract(import_str, '^(\.\./)*')) // 3)"
_REL = (
    rf"array_to_string(list_concat(list_slice(string_split(dir, '/'), 1, len(string_split(dir, '/')) - {_CLIMB}), "
    rf"string_split(regexp_replace(import_str, '^(\.\./)*', ''), '/')), '/')"
)


def _cands(base: str, suffixes) -> str:
    return "[" + ", ".join(f"{base} || {_lit(s)}" for s in suffixes) + "]"


_INDEX = ["/" + i for i in K.SCRIPT_INDEX_FILES]
_abs = []
for _root in K.SCRIPT_ROOTS:
    _abs += [f"'{_root}/' || import_str || {_lit(s)}" for s in ["", *K.SCRIPT_ROOT_EXTENSIONS, *_INDEX]]
_abs += [f"case when starts_with(import_str, '@/') then 'src/' || substr(import_str, 3) || {_lit(s)} end" for s in ["", *K.SCRIPT_ALIAS_EXTENSIONS]]
_jvm = []
for _v in ("replace(import_str, '.', '/')", "replace(replace(import_str, '.', '/'), '_', '')", "import_str"):
    for _root in K.JVM_ROOTS:
        for _e in ["", *K.JVM_EXTENSIONS]:
            _jvm.append((f"'{_root}/' || " if _root else "") + f"{_v} || {_lit(_e)}")
_CANDIDATES = f"""case
  when family = 'SCRIPT' and starts_with(import_str, '../') then {_cands(_REL, ['', *K.SCRIPT_RELATIVE_EXTENSIONS, *_INDEX])}
  when family = 'SCRIPT' then [{', '.join(_abs)}]
  when family = 'JVM' then [{', '.join(_jvm)}]
  when family = 'PYTHON' then [replace(import_str, '.', '/') || '.py', import_str || '.py', replace(import_str, '.', '/') || '/__init__.py']
  when family = 'HTML' then [{_REL}]
  when family = 'CSS' then {_cands(_REL, ['', *K.CSS_EXTENSIONS])} end"""
cte("resolved", f"""
select i.repo, i.src, i.family, i.import_str, arg_min(n.path, i.ord) as dst from (
  select repo, src, family, import_str, unnest(c) as cand, unnest(generate_series(1, len(c))) as ord
  from (select *, {_CANDIDATES} as c from imports) r0) i
join nodes n on n.repo = i.repo and n.path = i.cand group by all""", "imports", "nodes")
cte("edges", "select distinct repo, src, dst from resolved", "resolved")
cte("direct", """
select distinct s.export_id, s.repo, e.dst as path from sel s join edges e on e.repo = s.repo and e.src = s.path
where not exists (select 1 from sel o where o.export_id = s.export_id and o.repo = s.repo and o.path = e.dst)""", "sel", "edges")
cte("closed", """
select export_id, repo, path from sel
union
select c.export_id, c.repo, e.dst as path from closed c join edges e on e.repo = c.repo and e.src = c.path""", "sel", "edges")
cte("transitive", """
select c.export_id, c.repo, c.path from closed c left join sel s on s.export_id = c.export_id and s.repo = c.repo and s.path = c.path
where s.path is null""", "closed", "sel")
cte("candidates", rf"""
select distinct s.export_id, f.repo, f.path from (select distinct export_id, repo, stem from sources where stem <> '') s
join files f on f.repo = s.repo
where f.ext in {_in(K.DEPENDENT_EXTENSIONS)} and f.size_bytes <= {K.DEPENDENT_MAX_BYTES}
  and not list_has_any(string_split(f.dir, '/'), {_list(K.DEPENDENT_SKIP_DIRS)})
  and regexp_matches(f.content, '(?:^|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])' || replace(s.stem, '.', '\.') || '(?:$|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])')
  and not exists (select 1 from sel o where o.export_id = s.export_id and o.repo = f.repo and o.path = f.path)""", "sources", "files", "sel")
cte("dependents", f"""
select export_id, repo, path from (
  select d.*, row_number() over (partition by export_id order by path, repo) as rk from (
    select distinct s.export_id, e.repo, e.src as path from sel s join edges e on e.repo = s.repo and e.dst = s.path
    join candidates c on c.export_id = s.export_id and c.repo = e.repo and c.path = e.src) d) d1
where rk <= {K.DEPENDENT_CAP}""", "sel", "edges", "candidates")
cte("bidi", f"""
select export_id, repo, path from (
  select export_id, repo, path from dependents union select export_id, repo, path from transitive
  union select d.export_id, e.repo, e.dst as path from (
    select *, row_number() over (partition by export_id order by path, repo) as rk from dependents) d
    join edges e on e.repo = d.repo and e.src = d.path where d.rk <= {K.DEPENDENT_EXPAND_LIMIT}) b0
where not exists (select 1 from sel o where o.export_id = b0.export_id and o.repo = b0.repo and o.path = b0.path)""",
    "dependents", "transitive", "edges", "sel")

# --- inheritance --------------------------------------------------------------------------------------------
_DECL = " union all ".join(
    f"select repo, path, unnest(regexp_extract_all(content, {_lit(p)}, 1)) as name, '{kind}' as kind from files "
    f"where language in {_in(K.SCRIPT_LANGUAGES)}" for kind, p in K.INHERITABLE_PATTERNS.items()
)
cte("declared", _DECL, "files")
# Every declared name is tested against every script of its repository.
_IMPL = r"""
select distinct s.export_id, f.repo, f.path from sel s join declared d on d.repo = s.repo and d.path = s.path
join files f on f.repo = d.repo and f.path <> d.path
where f.language in ('JAVASCRIPT','TYPESCRIPT','JSX','TSX') and case
  when d.kind in ('CLASS', 'ABSTRACT_CLASS') then regexp_matches(f.content, 'class\s+[A-Z][a-zA-Z0-9_]*\s+extends\s+' || d.name || '(?:\s|<|,|\{)')
  when d.kind = 'INTERFACE' then regexp_matches(f.content, '(?:implements|extends)\s+(?:[^,\s{]*,\s*)*' || d.name || '(?:\s|<|,|\{)')
  else regexp_matches(f.content, '(?:withRouter|connect|memo|forwardRef)\s*\(\s*' || d.name || '\s*\)')
    or regexp_matches(f.content, 'const\s+[A-Z][a-zA-Z0-9_]*\s*=\s*\([^)]*\)\s*=>\s*<' || d.name) end"""
# JVM types: arguments go from the innermost outwards, then the list of super-types is read name by name.
_ARGS = r"'\([^()]*\)|<[^()<>{};=]*>'"
cte("jvm_bare", f"""
select repo, path, replace(content, '->', ' ') as bare from files where language in ('JAVA', 'KOTLIN')
union all
select repo, path, regexp_replace(bare, {_ARGS}, '', 'g') as bare from jvm_bare where regexp_matches(bare, {_ARGS})""", "files")
_JT = r"\s*(?:@[\w.]+\s+)*[\w.]+(?:\s+by\s+[\w.]+)?"
_JL = rf"(?::|\bextends\b|\bimplements\b){_JT}(?:\s*,{_JT})*"
_JH = rf"\b(?:class|interface|object)\s+([A-Z]\w*)(?:\s+[@\w. ]*\bconstructor\b)?\s*({_JL}(?:\s+{_JL})*)"
cte("jvm_supers", f"""
select distinct repo, path, regexp_extract(h, '{_JH}', 1) as name,
  unnest(regexp_extract_all(regexp_extract(h, '{_JH}', 2), '(?:[:,]|\\bextends\\b|\\bimplements\\b)\\s*(?:@[\\w.]+\\s+)*(?:\\w+\\.)*([A-Z]\\w*)', 1)) as super_name
from (select repo, path, unnest(regexp_extract_all(bare, '{_JH}', 0)) as h from jvm_bare where not regexp_matches(bare, {_ARGS})) h0""", "jvm_bare")
cte("jvm_closed", r"""
select distinct s.export_id, s.repo, unnest(regexp_extract_all(f.content, '\b(?:class|interface|object)\s+([A-Z]\w*)', 1)) as name
from sel s join files f using (repo, path) where f.language in ('JAVA', 'KOTLIN')
union
select c.export_id, c.repo, u.name from jvm_closed c join jvm_supers u on u.repo = c.repo and u.super_name = c.name""", "sel", "files", "jvm_supers")
cte("jvm_subtypes", """
select distinct c.export_id, c.repo, u.path from jvm_closed c join jvm_supers u on u.repo = c.repo and u.super_name = c.name
where not exists (select 1 from sel o where o.export_id = c.export_id and o.repo = c.repo and o.path = u.path)""", "jvm_closed", "jvm_supers", "sel")
cte("implementing", _IMPL, "sel", "declared", "files")
_IS_TEST = (
    "(contains('/' || path, '/test/') or contains('/' || path, '/tests/') or contains('/' || path, '/__tests__/') "
    r"or regexp_matches(stem, '(?:Test|Tests|Spec)$|^Test|\.test\.|\.spec\.') "
    r"or (regexp_matches(stem, '(?i)test') and regexp_matches(stem, '(?:IT|IntegrationTest|E2ETest)$')))"
)
cte("stat_kinds", r"""
select repo, path, kind from declared
union all
select repo, path, case when kw = 'interface' then 'INTERFACE' when regexp_matches(mods, '\b(?:abstract|open|sealed)\b') then 'ABSTRACT_CLASS' else 'CLASS' end as kind
from (select repo, path, unnest(regexp_extract_all(content, '(?m)^[ \t]*((?:[a-z]+[ \t]+)*)(class|interface|object)\s+[A-Z]\w*', 1)) as mods,
  unnest(regexp_extract_all(content, '(?m)^[ \t]*((?:[a-z]+[ \t]+)*)(class|interface|object)\s+[A-Z]\w*', 2)) as kw
  from files where language in ('JAVA', 'KOTLIN')) k0""", "declared", "files")

# --- names and places -----------------------------------------------------------------------------------------
def _names(templates) -> str:
    out = []
    for t in templates:
        e = _lit(t).replace("{}", "' || stem || '").replace("{ext}", "' || coalesce(lower(ext), '') || '")
        out.append(e)
    return "[" + ", ".join(out) + "]"


cte("named_tests", f"""
select distinct w.export_id, f.repo, f.path from (
  select export_id, repo, unnest(case family {' '.join(f"when '{fam}' then {_names(t)}" for fam, t in K.TEST_NAMES.items())} end) as name from sources) w
join files f using (repo, name)""", "sources", "files")
cte("folder_tests", """
select distinct s.export_id, f.repo, f.path from sources s join files f on f.repo = s.repo
where s.family = 'SCRIPT' and s.stem <> '' and (
  (f.dir in (s.dir || '/__tests__', s.dir || '/tests') and contains(lower(f.stem), lower(s.stem)))
  or (f.dir = s.dir and starts_with(f.stem, s.stem) and (contains(f.name, '.test.') or contains(f.name, '.spec.'))))""", "sources", "files")
cte("tests", "select * from named_tests union select * from folder_tests", "named_tests", "folder_tests")
_IN_TEST = lambda p: _any(f"contains('/' || {p}, {{}})", K.TEST_DIR_MARKERS)
_EXT_NAMES = "[" + ", ".join(_lit(p).replace("*", "' || stem || '") + " || '.' || ext" for p in K.EXTENDED_TEST_PATTERNS) + "]"


def _extended(name: str, sources: str) -> None:
    cte(name, f"""
select distinct w.export_id, f.repo, f.path from (select export_id, repo, unnest({_EXT_NAMES}) as name from {sources} where ext is not null) w
join files f using (repo, name)""", sources, "files")


_extended("ext_tests", "sources")
_extended("app_ext_tests", "appsources")
_TEST_DIRS = """
select distinct s.export_id, f.repo, f.path from {src} s join files f on f.repo = s.repo and f.ext = s.ext
where {cond} and s.stem <> '' and contains(lower(f.stem), lower(s.stem))"""
cte("dir_tests", _TEST_DIRS.format(src="sources", cond=_IN_TEST("f.path")), "sources", "files")
cte("app_dir_tests", _TEST_DIRS.format(src="appsources", cond=_IN_TEST("f.path")), "appsources", "files")
cte("res_tests", f"""
select repo, path from files where {_IN_TEST('path')} and {_any("contains(lower('/' || path), '/' || {} || '/')", K.TEST_RESOURCE_DIRS)}""", "files")
cte("util_tests", f"select repo, path from files where name in {_in([f'{p}.{e}' for p in K.TEST_UTILITY_PATTERNS for e in K.TEST_UTILITY_EXTENSIONS])}", "files")
cte("app_tests", """
select * from app_ext_tests union select * from app_dir_tests
union select distinct s.export_id, t.repo, t.path from appsel s join (select * from res_tests union select * from util_tests) t using (repo)""",
    "app_ext_tests", "app_dir_tests", "appsel", "res_tests", "util_tests")
_MATCH_NAME = "(" + " or ".join(
    f"ends_with(lower(stem), {_lit(p[1:].lower())})" if p.startswith("*") else f"starts_with(lower(stem), {_lit(p[:-1].lower())})"
    for p in K.EXTENDED_TEST_PATTERNS
) + ")"
_STYLES = "[" + ", ".join(f"stem || '.{e}'" for e in K.STYLE_EXTENSIONS) + "]"
_MODULES = "[" + ", ".join(f"stem || '.module.{e}'" for e in K.STYLE_EXTENSIONS) + "]"


def _linked(name: str, wanted: str) -> None:
    cte(name, f"select distinct w.repo, w.src, f.path as dst from ({wanted}) w join files f on f.repo = w.repo and f.name = w.name", "files")


_linked("r_spring", f"""
select repo, src, view || '.' || e as name from (
  select repo, path as src, unnest(regexp_extract_all(content, {_lit(K.SPRING_VIEW_PATTERN)}, 1)) as view from files
  where language in ('JAVA', 'KOTLIN') and {_any('contains(content, {})', K.SPRING_MARKERS)}) v0,
  lateral (select unnest({_list(K.TEMPLATE_EXTENSIONS)}) as e)""")
_linked("r_react", f"""
select repo, path as src, unnest(list_concat({_STYLES}, {_MODULES})) as name from files
where lower(ext) in ('jsx','tsx','js','ts') and {_any('contains(content, {})', K.REACT_MARKERS)}""")
_linked("r_vue", f"""
select repo, path as src, unnest({_STYLES}) as name from files
where coalesce(lower(ext), '') = 'vue' or {_any('contains(content, {})', K.VUE_MARKERS)}""")
_linked("r_naming", f"""
select repo, path as src, unnest(list_transform(list_filter({_list(K.RESOURCE_EXTENSIONS)}, lambda e: e <> coalesce(ext, '')), lambda e: stem || '.' || e)) as name from files""")
cte("r_angular", f"""
select distinct w.repo, w.src, f.path as dst from (
  select repo, src, {_REL} as path from (
    select repo, path as src, dir, unnest(list_concat([regexp_extract(content, {_lit(K.ANGULAR_TEMPLATE_PATTERN)}, 1)],
      regexp_extract_all(regexp_extract(content, {_lit(K.ANGULAR_STYLES_PATTERN)}, 1), {_lit(K.QUOTED_PATTERN)}, 1))) as import_str
    from files where language = 'TYPESCRIPT' and contains(content, '@Component')) a0 where import_str <> '') w
join files f on f.repo = w.repo and f.path = w.path""", "files")
cte("literals", f"""
select repo, src, import_str, {_REL} as path, regexp_extract(import_str, '[^/]*$') as name from (
  select repo, path as src, dir, unnest(regexp_extract_all(content, {_lit(K.RESOURCE_LITERAL_PATTERN)}, 1)) as import_str from files) l0""", "files")
cte("r_literal", """
select distinct l.repo, l.src, coalesce(near.path, far.path) as dst from literals l
left join files near on near.repo = l.repo and near.path = l.path
left join files far on far.repo = l.repo and far.name = l.name and near.path is null
where coalesce(near.path, far.path) is not null""", "literals", "files")
cte("resources", " union ".join(f"select * from r_{n}" for n in ("spring", "react", "vue", "angular", "literal", "naming")),
    "r_spring", "r_react", "r_vue", "r_angular", "r_literal", "r_naming")
cte("related_res", "select distinct s.export_id, s.repo, r.dst as path from sel s join resources r on r.repo = s.repo and r.src = s.path", "sel", "resources")
_CONFIG = f"list_concat({_list(K.CONFIG_NAMES['BASE'])}, case family " + " ".join(
    f"when '{f}' then {_list(n)}" for f, n in K.CONFIG_NAMES.items() if f != "BASE"
) + " else []::varchar[] end)"
cte("configs", f"""
select distinct w.export_id, f.repo, f.path from (select export_id, repo, dir, unnest({_CONFIG}) as name from sources) w
join files f on f.repo = w.repo and f.name = w.name and f.dir in ('', w.dir)""", "sources", "files")
cte("peers", """
select distinct s.export_id, f.repo, f.path from sources s join files f on f.repo = s.repo and f.dir = s.dir and f.path <> s.path""", "sources", "files")


_PASSES = (
    f"f.name not in {_in(K.IGNORED_NAMES)} and not coalesce(lower(f.ext) in {_in(K.BINARY_EXTENSIONS)}, false) "
    f"and f.size_bytes <= {LIMITS.max_file_size_kb} * 1024 and not {_BINARY.replace('content', 'f.content')}"
)


def _first(limit: int | None) -> str:
    return "" if limit is None else f"\nwhere rk <= {limit}"


def _kept_of(related: str, selection: str = "sel", only_if_found: bool = False, limit: int | None = 200) -> str:
    """First ``limit`` kept files (none: all) of an export of explicitly named files, the selection before the
    related files (directories among the relations are walked: none here)."""
    found = f" where export_id in (select export_id from {related})" if only_if_found else ""
    return f"""
select export_id, repo, path, approx_tokens from (
  select u.export_id, f.repo, f.path, b.approx_tokens,
    row_number() over (partition by u.export_id order by u.o, string_split(f.path, '/')) as rk
  from (select export_id, repo, path, min(o) as o from (
    select export_id, repo, path, 0 as o from {selection}{found}
    union all select export_id, repo, path, 1 as o from {related}) u0 group by all) u
  join files f using (repo, path) join bodies b using (repo, path) where {_PASSES}) k0{_first(limit)}"""


def _kept_only(chosen: str, group: str = "repo", limit: int | None = 200) -> str:
    return f"""
select * exclude (rk) from (
  select c.*, b.approx_tokens, row_number() over (partition by c.{group} order by string_split(f.path, '/')) as rk
  from ({chosen}) c join files f using (repo, path) join bodies b using (repo, path) where {_PASSES}) k0{_first(limit)}"""


# --- traces ------------------------------------------------------------------------------------------------
cte("lines", V.trace_lines_sql("duckdb"))
cte("classified", rf"""
select *, case when kind = 'frame' then regexp_extract(line, {_lit(K.FRAME_PATTERN)}, 1) end as class_name, regexp_extract(line, '^[ \t]*') as indent
from (select *, case when regexp_matches(trim(line, chr(9) || ' '), {_lit(K.CAUSED_BY_PATTERN)}) then 'caused_by'
  when regexp_matches(trim(line, chr(9) || ' '), {_lit(K.SUPPRESSED_PATTERN)}) then 'suppressed'
  when regexp_matches(line, {_lit(K.FRAME_PATTERN)}) then 'frame'
  when regexp_matches(trim(line, chr(9) || ' '), {_lit(K.ELLIPSIS_PATTERN)}) then 'ellipsis' else 'other' end as kind from lines) c0""", "lines")
_PLAIN = "regexp_extract(class_name, '[^/]*$')"
cte("foldable", f"""
select *, kind = 'frame' and not {_any(f'starts_with({_PLAIN}, {{}})', K.NEVER_FOLD_PREFIXES)}
  and ({_any(f'starts_with({_PLAIN}, {{}})', K.ALWAYS_FOLD_PREFIXES)} or class_name <> 'com.shop.Core') as foldable from classified""", "classified")
cte("islands", r"""
select *, case when foldable then pos - row_number() over (partition by trace_id, foldable order by pos) end as island from (
  select *, row_number() over (partition by trace_id order by line_no) as pos from (
    select * replace (coalesce(foldable, false) as foldable) from foldable) f0
  where regexp_matches(line, '\S')) f1""", "foldable")
cte("blocks", """
select *, count(*) over (partition by trace_id, foldable, island) as block_len,
  pos - row_number() over (partition by trace_id, foldable, island order by pos) as block,
  row_number() over (partition by trace_id, foldable, island order by pos) as nth,
  first_value(indent) over (partition by trace_id, foldable, island order by pos) as block_indent from islands""", "islands")
cte("shown", """
select *, foldable and block_len >= 3 and nth > least(1, block_len) and nth <= block_len - least(1, block_len - 1) as folded from blocks""", "blocks")
_CLS = f"regexp_replace({_PLAIN}, '\\.[^.]*$', '')"
cte("hints", f"""
select trace_id, block, string_agg(pkg || '.*(' || n || ')', ', ' order by n desc, pkg) as hints from (
  select *, row_number() over (partition by trace_id, block order by n desc, pkg) as rk from (
    select trace_id, block, case when regexp_matches({_CLS}, '^(org|com)\\.') then regexp_extract({_CLS}, '^[^.]*\\.[^.]*') else split_part({_CLS}, '.', 1) end as pkg,
      count(*) as n from shown where folded and contains({_PLAIN}, '.') group by all) h0) h1
where rk <= 3 group by trace_id, block""", "shown")
cte("folded", """
select trace_id, string_agg(text, chr(10) order by pos) as text from (
  select s.trace_id, s.pos, case when not s.folded then s.line else s.block_indent || '... ' || (s.block_len - 2) || ' folded frames'
    || coalesce(' (' || h.hints || ')', '') || ' ...' end as text
  from shown s left join hints h using (trace_id, block) where not s.folded or s.nth = 2) t0 group by trace_id""", "shown", "hints")
cte("raws", "select trace_id, string_agg(line, chr(10) order by line_no) as raw from lines group by trace_id", "lines")

cte("commits", V.COMMITS_SQL, "files")
cte("times", V.FILE_TIMES_SQL, "files")
cte("last_p", V.LAST_PATHS_SQL, "files")
cte("cur_p", V.CURRENT_PATHS_SQL, "files")
cte("history", V.EXPORT_HISTORY_SQL)
cte("latest", """
select distinct c.repo, c.path from commits c join (
  select repo, max(commit_id) as m from commits group by repo) l on l.repo = c.repo and l.m = c.commit_id
join files f on f.repo = c.repo and f.path = c.path where c.change_type <> 'deleted'""", "commits", "files")
cte("changed", """
select distinct c.export_id, c.repo, c.path from cur_p c
where not exists (select 1 from last_p l where l.export_id = c.export_id and l.repo = c.repo and l.path = c.path)
  and exists (select 1 from files f where f.repo = c.repo and f.path = c.path)""", "cur_p", "last_p", "files")
_KB = lambda b: f"case when {b} / 1024.0 < 1024 then printf('%.1f KB', round({b} / 1024.0, 1)) else printf('%.1f MB', round({b} / 1024.0 / 1024.0, 1)) end"
_LINE = lambda n, b, t: f"{n} || ' files, ' || {_KB(b)} || ', ~' || format('{{:,}}', cast({t} as bigint)) || ' tokens'"
_CATEGORY = f"""case
  when not coalesce(ext in {_in(K.TEST_CODE_EXTENSIONS)}, false) and (contains(lower('/' || path), '/test/') or contains(lower('/' || path), '/tests/')) then 'resource'
  when {_any('contains(lower(stem), {})', ['testutil', 'testhelper', 'mockutil', 'basetest'])} then 'utility'
  when {_any('contains(lower(stem), {})', ['e2e', 'endtoend'])} then 'e2e'
  when {_any('contains(lower(stem), {})', ['perf', 'performance', 'load', 'stress'])} then 'performance'
  when ends_with(lower(stem), 'it') or {_any('contains(lower(stem), {})', ['integration', 'inttest'])} then 'integration' else 'unit' end"""
_MD_PLAIN = f"(case when {_HAS('content')} then {_AFTER('content')} else content end)"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_files"] = sql("select repo, path, size_bytes from files", "files")
    q["expand_nodes"] = sql("select repo, path, name, is_dir, cast(size_bytes as bigint) as size_bytes from nodes", "nodes")
    q["dedup_selection"] = sql("select export_id, repo, path, root_ordinal from sel", "sel")
    q["relative_path"] = sql("select doc_id, case when repo = 'repo1' then path else name end as rel from files", "files")
    q["read_text"] = sql("select repo, path, content as text from files", "files")
    q["load_ignore_files"] = sql("select repo, dir as gi_dir, content as text from files where name = '.gitignore'", "files")
    q["load_commits"] = sql("select repo, commit_id, committed_at, path, change_type from commits", "commits")
    q["write_bundles"] = q["render_plain"] = sql("select export_id, text from plain", "plain")
    q["append_history"] = sql(f"""
select repo, export_id, file_count, size_bytes, tokens, {_LINE('file_count', 'size_bytes', 'tokens')} as summary from (
  select e.repo, e.export_id, count(*) as file_count, max(strlen(p.text)) as size_bytes, max({_TOKENS('p.text')}) as tokens
  from entries e join plain p using (export_id) group by e.repo, e.export_id) h0""", "entries", "plain")
    q["filter_ignored_name"] = sql(f"select repo, path, name in {_in(K.IGNORED_NAMES)} as excluded from nodes", "nodes")
    q["parse_ignore_rules"] = sql("select repo, gi_dir, rule_no, original, negated, dir_only, rooted, pattern from rules", "rules")
    q["compile_ignore_glob"] = sql("select repo, gi_dir, original, simple, path_regex, name_regex from compiled", "compiled")
    q["match_ignore_rule"] = sql("select repo, path, gi_dir, rule_no, cast(verdict as bigint) as verdict from matches", "matches")
    q["last_match_wins"] = sql("select repo, path, gi_dir, cast(arg_max(verdict, rule_no) as bigint) as verdict from matches group by repo, path, gi_dir", "matches")
    q["ignore_hierarchy"] = sql("select repo, path, ignored from ignored", "ignored")
    q["explicit_override"] = sql("select export_id, repo, path, explicit, coalesce(exclusion_reason = 'GITIGNORE', false) as excluded from walked where gitignored", "walked")
    q["prune_by_ancestor"] = sql("select export_id, repo, path, is_dir from reached", "reached")
    q["filter_known_binary"] = sql(f"select repo, path, coalesce(lower(ext) in {_in(K.BINARY_EXTENSIONS)}, false) as excluded from files", "files")
    q["filter_size"] = sql("select repo, path, size_bytes > 8192 as excluded from files", "files")
    q["filter_content_binary"] = sql(f"select repo, path, {_BINARY} as excluded from files", "files")
    q["filter_filename"] = sql("select repo, path, not (ends_with(lower(name), '.ts') or ends_with(lower(name), '.py') or ends_with(lower(name), '.java') or ends_with(lower(name), '.md')) as excluded from files", "files")
    q["exclusion_reason"] = sql("select export_id, repo, path, exclusion_reason from walkedf", "walkedf")
    q["drop_unreadable"] = sql("select repo, path from files where not starts_with(content, '// Error')", "files")
    q["render_entries"] = sql("select export_id, repo, path, body, approx_tokens from entries", "entries")
    q["pack_bundles"] = sql(f"""
select p.export_id, t.text || chr(10) || chr(10) || s.text || p.text as text from plain p join tree_entries t using (export_id)
join ({_summary('plain', 'entries', 'estats', "'Not a Git repository'")}) s using (export_id)""", "plain", "tree_entries", "estats", "bestwide")
    q["detect_language"] = sql("select repo, path, language from files", "files")
    q["number_lines"] = sql("select repo, path, numbered from numbered", "numbered")
    q["path_header"] = sql(f"select repo, path, {_HEADER} as header from files", "files")
    q["has_header"] = sql(f"select repo, path, {_HAS('content')} as before, {_HAS('t')} as after from (select *, {_HEADER} || chr(10) || content as t from files) h0", "files")
    q["render_markdown"] = sql(f"""
select export_id, string_agg('### ' || path || chr(10) || chr(10) || '```' || hint || chr(10) || {_MD_PLAIN} || chr(10) || '```' || chr(10) || chr(10), '' order by path) as text from (
  select l.export_id, f.path, f.content, coalesce(case when contains(f.path, '.') then {_case("lower(regexp_extract(f.path, '[^.]*$'))", K.FENCE_HINTS)}
    else coalesce({_case('f.name', K.FENCE_HINTS)}, {_case('lower(f.name)', K.FENCE_HINTS)}) end, 'text') as hint
  from limited l join files f using (repo, path) where l.kept) m0 group by export_id""", "limited", "files")
    q["render_xml"] = sql(f"""
select export_id, '<files>' || chr(10) || string_agg('  <file path="' || path || '">' || chr(10) || '    <content><![CDATA[' || chr(10)
  || case when {_HAS('body')} then {_AFTER('body')} else body end || chr(10) || '    ]]></content>' || chr(10) || '  </file>' || chr(10), '' order by path) || '</files>' as text
from entries group by export_id""", "entries")
    q["directory_tree"] = sql("select export_id, text from tree_wide", "tree_wide")
    q["token_count"] = sql(f"select repo, path, {_TOKENS('content')} as approx_tokens from files", "files")
    q["size_display"] = sql(f"""
select repo, path, {_KB('b')} as history, case when b / 1048576.0 >= 1 then printf('%.1fMB', round(b / 1048576.0, 1)) else printf('%.1fKB', round(b / 1024.0, 1)) end as notice,
  format('{{:,}}', b) as grouped from (select *, size_bytes * 97 as b from files) z""", "files")
    q["normalize_paths"] = sql("select doc_id, case when repo = 'repo1' then '' else path end as path from files", "files")
    q["extract_imports"] = sql("select repo, src, language, import_str from imports", "imports")
    for name, fam in (("js", "SCRIPT"), ("jvm", "JVM"), ("python", "PYTHON"), ("html", "HTML"), ("css", "CSS")):
        q[f"resolve_{name}"] = sql(f"select repo, src, import_str, dst from resolved where family = '{fam}'", "resolved")
    q["import_edges"] = sql("select repo, src, dst from edges", "edges")
    q["direct_imports"] = sql("select export_id, repo, path from direct", "direct")
    q["dependents_candidates"] = sql("select export_id, repo, path from candidates", "candidates")
    q["dependents"] = sql("select export_id, repo, path from dependents", "dependents")
    q["inheritable_elements"] = sql("select repo, path, name, kind from declared", "declared")
    q["implementations"] = sql(f"select i.export_id, i.repo, i.path from implementing i join files f using (repo, path) where not {_IS_TEST.replace('path', 'f.path')}", "implementing", "files")
    q["jvm_implementations"] = sql("select export_id, repo, path from jvm_subtypes", "jvm_subtypes")
    q["tests_by_name"] = sql("select * from named_tests", "named_tests")
    q["tests_in_folders"] = sql("select * from folder_tests", "folder_tests")
    q["tests_extended"] = sql("select * from ext_tests", "ext_tests")
    q["tests_in_test_dirs"] = sql("select * from dir_tests", "dir_tests")
    q["test_resources"] = sql("select * from res_tests", "res_tests")
    q["test_utilities"] = sql("select * from util_tests", "util_tests")
    q["all_test_files"] = sql(f"select repo, path from files where {_IN_TEST('path')} or {_MATCH_NAME}", "files")
    for name in ("spring", "react", "vue", "angular", "literal", "naming"):
        q[f"resources_{name}"] = sql(f"select repo, src, dst from r_{name}", f"r_{name}")
    q["related_resources"] = sql("select * from related_res", "related_res")
    q["config_files"] = sql("select * from configs", "configs")
    q["package_peers"] = sql("select * from peers", "peers")
    q["project_class_lookup"] = sql("select trace_id, line_no, class_name, coalesce(foldable, false) as foldable from foldable", "foldable")
    q["repo_membership"] = sql("""
select s.export_id, s.repo, s.path, r.repo_root, r.url from sel s join repos r on r.repo = s.repo and (s.path = r.repo_root or starts_with(s.path, r.repo_root || '/'))""", "sel", "repos")
    counts = ", ".join(f"count(*) filter (exclusion_reason = '{r}') as {r.lower()}" for r in
                       ("IGNORED_NAME", "GITIGNORE", "BINARY_CONTENT", "SIZE_LIMIT", "FILENAME_FILTER"))
    q["exclusion_counts"] = sql(f"select export_id, {counts}, count(*) filter (kept) as kept_files from limited group by export_id", "limited")
    q["excluded_extensions"] = sql("""
select export_id, array_to_string(exts, ',') as exts, array_to_string(exts[1:5], ', ') as shown from (
  select export_id, list_sort(list_distinct(list(coalesce(ext, 'no_extension')))) as exts from walkedf where exclusion_reason = 'FILENAME_FILTER' group by export_id) x""", "walkedf")
    q["bundle_totals"] = sql("select export_id, count(*) as files, cast(sum(chars) as bigint) as chars, cast(sum(tokens) as bigint) as tokens from stats group by export_id", "stats")
    q["pct_of_total"] = sql("select export_id, path, chars, round(chars / sum(chars) over (partition by export_id) * 100.0, 6) as pct from stats", "stats")
    q["repo_summary"] = sql(" union all ".join(_summary(k, "wide", "stats", "u.url") for k in ("plain", "markdown", "xml")), "stats", "wide", "bestwide")
    q["best_repo"] = sql(_BEST.format("sel"), "sel", "repos")
    q["implementation_stats"] = sql("""
select s.export_id, count(*) filter (kind = 'INTERFACE') as interfaces, count(*) filter (kind = 'ABSTRACT_CLASS') as abstract_or_open,
  count(*) filter (kind = 'CLASS') as concrete, count(*) filter (kind = 'REACT_COMPONENT') as components
from sel s join stat_kinds k using (repo, path) group by s.export_id""", "sel", "stat_kinds")
    cats = ["unit", "integration", "e2e", "performance", "resource", "utility"]
    labels = ["unit", "integration", "E2E", "performance", "resources", "utilities"]
    q["test_categories"] = sql(f"""
select *, 'All Tests Export (' || concat_ws(', ', {', '.join(f"case when n_{c} > 0 then n_{c} || ' {lb}' end" for c, lb in zip(cats, labels))}) || ')' as text from (
  select export_id, {', '.join(f"count(*) filter (cat = '{c}') as n_{c}" for c in cats)} from (
    select t.export_id, {_CATEGORY} as cat from app_tests t join files f using (repo, path)) c0 group by export_id) c1""", "app_tests", "files")
    q["package_hints"] = sql("select trace_id, block, hints from hints", "hints")
    q["estimate_files"] = sql("""
select export_id, least(count(distinct path), 1000) as n_files from (
  select s.export_id, f.path from walksel s join files f on f.repo = s.repo and (s.path = f.path or (s.is_dir and starts_with(f.path, s.path || '/')))) e0 group by export_id""", "walksel", "files")
    q["export_size"] = sql(f"select export_id, strlen(text) as size_bytes, {_TOKENS('text')} as tokens from plain", "plain")
    q["classify_lines"] = sql("select trace_id, line_no, kind, class_name, indent from classified", "classified")
    q["fold_blocks"] = sql("select trace_id, line_no, pos, block, block_len from blocks where foldable", "blocks")
    q["fold_traces"] = sql("select trace_id, text from folded", "folded")
    q["fold_lines"] = sql("""
select s.trace_id, s.line_no, case when not s.folded then s.line else s.block_indent || '... ' || (s.block_len - 2) || ' folded frames'
  || coalesce(' (' || h.hints || ')', '') || ' ...' end as line
from shown s left join hints h using (trace_id, block) where not s.folded or s.nth = 2""", "shown", "hints")
    # Sessions that ended an hour and ten minutes before the newest event; all lines of a trace carry one time.
    q["stream_fold_traces"] = sql("""
select f.trace_id, e.ts as session_start, f.text from folded f join events e on e.event_id = f.trace_id
where e.ts + interval 10 minute <= (select max(ts) from events) - interval 1 hour""", "folded")
    q["append_raw"] = sql(f"select trace_id, text || chr(10) || '{K.RAW_TRACE_MARKER}' || chr(10) || raw as text from folded join raws using (trace_id)", "folded", "raws")
    q["fold_and_emit"] = sql(f"""
select trace_id, text, length(text) as chars, {_TOKENS('text')} as tokens from (
  select trace_id, text || chr(10) || '{K.RAW_TRACE_MARKER}' || chr(10) || raw as text from folded join raws using (trace_id)) e""", "folded", "raws")
    q["dfs_order"] = sql("select repo, path, lag(path) over (partition by repo, dir order by string_split(path, '/')) as sibling_before from nodes", "nodes")
    q["file_limit"] = sql("select export_id, repo, path, kept from limited", "limited")
    q["limit_reached"] = sql(f"select export_id, count(*) filter (kept) >= {LIMITS.file_limit} as limit_reached from limited group by export_id", "limited")
    q["sort_entries"] = sql("select export_id, path, approx_tokens from entries order by export_id, path", "entries")
    q["top_files"] = sql("""
select * from (select export_id, path, chars, tokens, row_number() over (partition by export_id order by chars desc, path) as rank from stats) r where rank <= 10""", "stats")
    q["recent_exports"] = sql(f"""
select repo, export_id, ts, {_LINE('file_count', 'size_bytes', 'tokens')} as summary from (
  select *, row_number() over (partition by repo order by ts desc, export_id desc) as rk from history) h where rk <= 10""", "history")
    q["last_commit_files"] = sql("select repo, path from latest", "latest")
    q["cap_related"] = sql("select export_id, repo, path from (select *, row_number() over (partition by export_id order by path, repo) as rk from peers) p where rk <= 5", "peers")
    q["union_selection"] = sql("select export_id, repo, path from sel union select export_id, repo, path from peers", "sel", "peers")
    q["diff_added"] = sql("select export_id, repo, path from cur_p except select export_id, repo, path from last_p", "cur_p", "last_p")
    q["diff_removed"] = sql("select export_id, repo, path from last_p except select export_id, repo, path from cur_p", "cur_p", "last_p")
    q["diff_unchanged"] = sql("select export_id, repo, path from last_p intersect select export_id, repo, path from cur_p", "cur_p", "last_p")
    status = """
select export_id, repo, path, case when l.p is null then 'added' when c.p is null then 'removed' else 'unchanged' end as status
from (select *, path as p from cur_p) c full outer join (select *, path as p from last_p) l using (export_id, repo, path)"""
    q["export_diff"] = sql(status, "cur_p", "last_p")
    q["export_diff_text"] = sql(f"""
select c.export_id, 'Export Diff Summary' || chr(10) || '===================' || chr(10) || chr(10)
  || 'Previous: ' || coalesce(h.line, '') || chr(10) || 'Current: ' || {_LINE('c.n', 'c.b', 'c.t')} || chr(10) || chr(10)
  || coalesce('Added Files (' || d.added || '):' || chr(10) || d.plus || chr(10), '')
  || coalesce('Removed Files (' || d.removed || '):' || chr(10) || d.minus, '') as text
from (select p.export_id, count(*) as n, coalesce(sum(f.size_bytes), 0) as b, coalesce(sum({_TOKENS('f.content')}), 0) as t
  from cur_p p left join files f using (repo, path) group by p.export_id) c
join (select export_id, nullif(count(*) filter (status = 'added'), 0) as added, nullif(count(*) filter (status = 'removed'), 0) as removed,
    string_agg('+ ' || path || chr(10), '' order by path, repo) filter (status = 'added') as plus,
    string_agg('- ' || path || chr(10), '' order by path, repo) filter (status = 'removed') as minus
  from ({status}) s group by export_id) d using (export_id)
left join (select export_id, {_LINE('file_count', 'size_bytes', 'tokens')} as line from history) h using (export_id)""", "cur_p", "last_p", "files", "history")
    q["diff_counts"] = sql(f"""
select export_id, count(*) filter (status = 'added') as added, count(*) filter (status = 'removed') as removed,
  count(*) filter (status = 'unchanged') as unchanged from ({status}) d group by export_id""", "cur_p", "last_p")
    q["changes_only"] = sql("select export_id, repo, path from changed", "changed")
    q["transitive_imports"] = sql("select export_id, repo, path from transitive", "transitive")
    q["bidirectional_deps"] = sql("select export_id, repo, path from bidi", "bidi")
    q["export_selected"] = sql("select export_id, repo, path, approx_tokens from entries", "entries")
    q["export_direct_imports"] = sql(_kept_of("direct"), "direct", "sel", "files", "bodies")
    q["export_transitive_imports"] = sql(_kept_of("transitive", limit=None), "transitive", "sel", "files", "bodies")
    q["export_dependents"] = sql(_kept_of("dependents"), "dependents", "sel", "files", "bodies")
    q["export_bidirectional"] = sql(_kept_of("bidi", only_if_found=True), "bidi", "sel", "files", "bodies")
    cte("tests5", "select export_id, repo, path from (select *, row_number() over (partition by export_id order by path, repo) as rk from tests) t where rk <= 5", "tests")
    q["export_tests"] = sql(_kept_of("tests5", limit=None), "tests5", "sel", "files", "bodies")
    q["export_all_tests"] = sql(_kept_of("app_tests", "appsel", True), "app_tests", "appsel", "files", "bodies")
    q["export_resources"] = sql(_kept_of("related_res", only_if_found=True, limit=None), "related_res", "sel", "files", "bodies")
    cte("all_subtypes", "select export_id, repo, path from implementing union select export_id, repo, path from jvm_subtypes", "implementing", "jvm_subtypes")
    q["export_implementations"] = sql(_kept_of("all_subtypes"), "all_subtypes", "sel", "files", "bodies")
    q["export_configs"] = sql(_kept_of("configs"), "configs", "sel", "files", "bodies")
    q["export_package"] = sql(_kept_of("peers"), "peers", "sel", "files", "bodies")
    q["export_recent_changes"] = sql(_kept_only(f"select repo, path from times where mtime > {NOW} - interval 24 hours"), "times", "files", "bodies")
    q["export_last_commit"] = sql(_kept_only("select repo, path from latest", limit=None), "latest", "files", "bodies")
    q["export_changes_only"] = sql(_kept_only("select export_id, repo, path from changed", "export_id"), "changed", "files", "bodies")
    # Windows that end before the newest event minus the allowed delay.
    q["stream_recent_changes"] = sql("""
select w as window_start, w + interval 24 hours as window_end, 'repo' || (user_id % 20) as repo, count(*) as n_changes
from events, lateral (select unnest(generate_series(0, 23)) as h), lateral (select date_trunc('hour', ts) - h * interval 1 hour as w)
where w + interval 24 hours <= (select max(ts) from events) - interval 1 hour group by all""")
    q["stream_history"] = sql("""
select repo, export_id, ts, file_count from (select *, row_number() over (partition by repo order by ts desc, export_id desc) as rk from history) h where rk <= 10""", "history")
    return q
