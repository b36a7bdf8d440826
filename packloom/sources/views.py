"""Corpus views derived from the given tables, as SQL text that Spark and DuckDB both run.

``documents`` becomes a table of files in twenty repositories (every row, whole texts); ``events``
becomes stack traces, an export history and a stream of changes. ``dialect`` only switches the
byte-length function and the row generator.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom import constants as K
from packloom.session import data_path, materialize

NL = "chr(10)"


def _s(n: str) -> str:
    return f"({n} % 10)"


def _b(n: str) -> str:
    return f"cast(floor({n} / 10) as bigint)"


def _str(expr: str) -> str:
    return f"cast({expr} as varchar(20))"


def _ext(n: str) -> str:
    names = ["ts", "tsx", "kt", "java", "py", "css", "html", "md", "log", "png"]
    return "case " + _s(n) + " " + " ".join(f"when {i} then '{e}'" for i, e in enumerate(names)) + " end"


def _stem(n: str) -> str:
    """Files of odd blocks are tests of the block before; styles and pages share the stem of a source."""
    before = _str(f"({n} - 10)")
    odd = f"{_b(n)} % 2 = 1"
    return (
        f"(case when {n} = 33 then 'BaseTest' when {_s(n)} in (5, 6) then 'f' || {_str(f'({n} - 4)')} "
        f"when {odd} and {_s(n)} in (0, 1) then 'f' || {before} || '.test' "
        f"when {odd} and {_s(n)} in (2, 3) then 'f' || {before} || 'Test' "
        f"when {odd} and {_s(n)} = 4 then 'test_f' || {before} else 'f' || {_str(n)} end)"
    )


def _own_dir(n: str) -> str:
    return (
        f"(case ({n} + {_b(n)}) % 4 when 0 then 'src/app' "
        f"when 1 then case when {_s(n)} >= 5 then 'src/test/fixtures' else 'src/test' end "
        f"when 2 then 'build/gen' else 'docs/ref' end || '/p' || {_str(f'cast(floor({n} / 50) as bigint)')})"
    )


def _dir(n: str) -> str:
    odd = f"{_b(n)} % 2 = 1"
    prev = f"({n} - 10)"
    return (
        f"(case when {odd} and {_s(n)} = 0 then {_own_dir(prev)} "
        f"when {odd} and {_s(n)} = 1 then {_own_dir(prev)} || '/__tests__' else {_own_dir(n)} end)"
    )


# Source heads per kind of file; @-marks are filled in per row.
_HEADS = {
    "ts": """import a from "@up@rel1"
import b from "@up@p2"
import c from "app/p0/f0"
@Component(templateUrl: "@up@own6.html", styleUrls: ["@up@own5.css"])
export class C@n extends C@t1 implements I@t2 {
}
export interface I@n {
}
""",
    "tsx": """import React from ''react''
import a from "@up@rel1"
import b from "@/test/p0/f@t2"
export abstract class C@n extends C@t2 {
}
export const W@n = (p) => <W@t2 />
memo(W@t2)
export default {
}
""",
    "kt": """import @dot1
import @dot2
@Controller
open class C@n : C@t2() {
fun v() = run { return "@view" }
}
""",
    "java": """import @dot1;
import @dot2;
public class C@n extends C@t1 implements I@t2 {
}
""",
    "py": """import @dot1
from @dot2 import x
""",
    "css": """@import "@up@p2.css"
""",
    "html": """<script src="@up@p0.ts"></script>
<link rel=x href="@up@p5.css">
""",
}
_ROOT_RULES = """# root rules
*.log
!f18.log
/docs/ref/p1/
f?6.html
src/**/*.sass
  
"""
_APP_RULES = """f?.css
gen/
!f8.log
f[0-4]4.py
"""
_DOC_RULES = """!*8.log
*.html
/f3.java
"""


def files_sql(dialect: str, documents: str = "documents") -> str:
    n_bytes = "octet_length" if dialect == "spark" else "strlen"
    k = _str("cast(floor(n / 50) as bigint)")
    b5, b6, b0 = "(b * 10 + 5)", "(b * 10 + 6)", "(b * 10)"
    head = (
        f"case when nm = '.gitignore' then case when d = '' then '{_ROOT_RULES}' "
        f"when d like 'src/app%' then '{_APP_RULES}' else '{_DOC_RULES}' end || '# ' "
        + " ".join(f"when s = {i} then '{_HEADS[e]}'" for i, e in
                   enumerate(["ts", "tsx", "kt", "java", "py", "css", "html"]))
        + " when s = 8 and b % 3 = 2 then repeat(chr(1), 600) else '' end"
    )
    marks = {
        "@up": f"repeat('../', cast(length(d) - length(replace(d, '/', '')) + 1 as int))",
        "@rel1": "p1 || case when e1 in ('ts', 'tsx') then '' else '.' || e1 end",
        "@own5": "own5", "@own6": "own6",
        "@dot1": "replace(p1, '/', '.')", "@dot2": "replace(p2, '/', '.')",
        "@p2": "p2", "@p0": "p0", "@p5": "p5",
        "@t1": _str("t1"), "@t2": _str("t2"), "@view": _stem(b6), "@n": _str("n"),
    }
    filled = "head"
    for mark, value in marks.items():
        filled = f"replace({filled}, '{mark}', {value})"
    return f"""
select repo, r, n, doc_id, path, dir, cast({n_bytes}(content) as bigint) as size_bytes, content
from (
  select repo, r, n, doc_id, case when d = '' then nm else d || '/' || nm end as path, d as dir,
    {filled} || case when nm = '.gitignore' then replace(text, {NL}, {NL} || '# ') else text end as content
  from (
    select *, {head} as head
    from (
      select *,
        case when s = 7 and (n = 7 or b % 5 in (1, 2)) then '.gitignore'
             when s = 7 and b % 5 = 3 then 'package.json'
             when n = 47 then 'Dockerfile'
             when s = 7 and b % 5 = 4 then 'tsconfig.json'
             else st || '.' || e end as nm,
        case when s = 7 and n in (7, 37, 47) then ''
             when s = 7 and b % 5 in (1, 3) then 'src/app/p' || {k}
             when s = 7 and b % 5 = 2 then 'docs/ref/p' || {k}
             when s = 7 and b % 5 = 4 then 'src/test/p' || {k}
             else d_ end as d
      from (
        select *, {_ext('n')} as e, {_stem('n')} as st, {_dir('n')} as d_, {_ext('t1')} as e1,
          {_dir('t1')} || '/' || {_stem('t1')} as p1, {_dir('t2')} || '/' || {_stem('t2')} as p2,
          {_dir(b0)} || '/' || {_stem(b0)} as p0, {_dir(b5)} || '/' || {_stem(b5)} as p5,
          {_own_dir(b5)} || '/' || {_stem(b5)} as own5, {_own_dir(b6)} || '/' || {_stem(b6)} as own6
        from (
          select *, 'repo' || {_str('r')} as repo, n % 10 as s,
            b * 10 + (n % 10) + 1 - 2 * (n % 2) as t1,
            cast(floor(b / 2) as bigint) * 10 + n % 10 as t2
          from (
            select doc_id, text, doc_id % 20 as r, cast(floor(doc_id / 20) as bigint) as n,
              cast(floor(doc_id / 200) as bigint) as b
            from {documents}) a0) a1) a2) a3) a4) a5"""


# Every file belongs to exactly one selection of up to seven consecutive files of its repository.
FILE_SELECTIONS_SQL = """
select r + 20 * cast(floor(n / 7) as bigint) as export_id, repo,
  cast(n % 7 as int) as root_ordinal, path, false as is_dir from files"""

# One export per repository: its top-level entries, after one file named explicitly.
WALK_SELECTIONS_SQL = """
select distinct r as export_id, repo,
  case when dir = '' then 4 when path like 'src/%' then 1 when path like 'docs/%' then 2 else 3 end as root_ordinal,
  case when dir = '' then path when path like 'src/%' then 'src' when path like 'docs/%' then 'docs' else 'build' end as path,
  dir <> '' as is_dir from files
union all
select r as export_id, repo, 0 as root_ordinal, path, false as is_dir from files where n = 8"""

# One export per repository: its application sources.
APP_SELECTIONS_SQL = """
select r as export_id, repo, 0 as root_ordinal, path, false as is_dir from files where path like 'src/app/%'"""

COMMITS_SQL = """
select repo, doc_id % 50 as commit_id,
  cast('2024-01-01 00:00:00' as timestamp) + (doc_id % 50) * interval '1' hour as committed_at,
  path, case when doc_id % 11 = 0 then 'deleted' else 'modified' end as change_type from files
union all
select distinct repo, cast(49 as bigint) as commit_id,
  cast('2024-01-01 00:00:00' as timestamp) + 49 * interval '1' hour as committed_at,
  'gone/away.ts' as path, 'modified' as change_type from files"""

FILE_TIMES_SQL = """
select repo, path, cast('2024-03-01 12:00:00' as timestamp) - (doc_id % 48) * interval '1' hour as mtime from files"""

# Two states of every export: a third of the paths was elsewhere before, a fifth is elsewhere now.
LAST_PATHS_SQL = """
select r as export_id, repo, case when doc_id % 3 = 0 then 'old/' || path else path end as path from files"""

CURRENT_PATHS_SQL = """
select r as export_id, repo, case when doc_id % 5 = 0 then 'new/' || path else path end as path from files"""

REPOS_SQL = """
select repo, 'src' as repo_root, 'ssh://git/' || repo || '-src' as url from files group by repo
union all
select repo, 'src/test' as repo_root, 'ssh://git/' || repo || '-test' as url from files group by repo
union all
select repo, 'docs' as repo_root, 'ssh://git/' || repo || '-docs' as url from files group by repo"""

PROJECT_CLASSES_SQL = "select 'com.shop.Core' as class_name"

EXPORT_HISTORY_SQL = """
select 'repo' || cast(user_id % 20 as varchar(20)) as repo, event_id as export_id, ts,
  cast(1 + event_id % 30 as int) as file_count, event_id * 917 as size_bytes, event_id * 131 as tokens
from events"""


def trace_lines_sql(dialect: str) -> str:
    rows = (
        "from events lateral view explode(sequence(0L, 3 + event_id % 9)) x as i"
        if dialect == "spark"
        else "from events, lateral (select unnest(generate_series(0, 3 + event_id % 9)) as i)"
    )
    return f"""
select event_id as trace_id, cast(i as bigint) as line_no,
  case when i = 0 then 'java.lang.IllegalStateException: event ' || cast(event_id as varchar(20))
       when i = 2 and event_id % 5 = 0 then '   '
       when (event_id + i) % 13 = 0 then 'Caused by: java.io.IOException: step ' || cast(i as varchar(20))
       when (event_id + i) % 17 = 0 then chr(9) || '... ' || cast(i as varchar(20)) || ' more'
       else chr(9) || 'at ' ||
            case (event_id * 7 + i * 3) % 11 when 0 then 'com.mycompany.myapp.Svc' when 1 then 'com.shop.Core'
              when 2 then 'com.vendor.Lib' when 3 then 'org.hibernate.Session'
              when 4 then 'java.base/java.util.HashMap' else 'java.util.ArrayList' end ||
            '.run(Src.java:' || cast(10 + i as varchar(20)) || ')' end as line
{rows}"""


_INGESTED: dict[tuple[str, str], DataFrame] = {}


class Corpus:
    """The derived views of one data folder, as lazily built DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._views: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._views:
            self._views[name] = self.spark.read.parquet(data_path(self.sf_dir, name))
        return self._views[name]

    def sql(self, name: str, text: str, **sources: DataFrame) -> DataFrame:
        if name not in self._views:
            for source, df in sources.items():
                df.createOrReplaceTempView(source)
            self._views[name] = self.spark.sql(text)
        return self._views[name]

    @property
    def raw_files(self) -> DataFrame:
        """The file table, ingested once per session: written to the shared folder so that metadata
        queries prune the content column and every later query reads columnar data. Ignore files lie apart,
        so that rules are read without the other texts."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _INGESTED:
            self.table("documents").createOrReplaceTempView("documents")
            files = self.spark.sql(files_sql("spark")).withColumn("ignore_file", F.substring_index("path", "/", -1) == K.IGNORE_FILE)
            _INGESTED[key] = materialize(files, "files", "ignore_file")
        return _INGESTED[key]

    @property
    def files(self) -> DataFrame:
        """repo, path, size_bytes, content and the path columns."""
        from packloom.functions.paths import with_path_columns

        return with_path_columns(self.raw_files.select("repo", "doc_id", "path", "size_bytes", "content", "ignore_file"))

    @property
    def file_selections(self) -> DataFrame:
        return self.sql("_file_selections", FILE_SELECTIONS_SQL, files=self.raw_files)

    @property
    def walk_selections(self) -> DataFrame:
        return self.sql("_walk_selections", WALK_SELECTIONS_SQL, files=self.raw_files)

    @property
    def app_selections(self) -> DataFrame:
        return self.sql("_app_selections", APP_SELECTIONS_SQL, files=self.raw_files)

    @property
    def commits(self) -> DataFrame:
        return self.sql("_commits", COMMITS_SQL, files=self.raw_files)

    @property
    def file_times(self) -> DataFrame:
        return self.sql("_file_times", FILE_TIMES_SQL, files=self.raw_files)

    @property
    def last_paths(self) -> DataFrame:
        return self.sql("_last_paths", LAST_PATHS_SQL, files=self.raw_files)

    @property
    def current_paths(self) -> DataFrame:
        return self.sql("_current_paths", CURRENT_PATHS_SQL, files=self.raw_files)

    @property
    def repos(self) -> DataFrame:
        return self.sql("_repos", REPOS_SQL, files=self.raw_files)

    @property
    def project_classes(self) -> DataFrame:
        return self.sql("_project_classes", PROJECT_CLASSES_SQL)

    @property
    def trace_lines(self) -> DataFrame:
        return self.sql("_trace_lines", trace_lines_sql("spark"), events=self.table("events"))

    @property
    def export_history(self) -> DataFrame:
        return self.sql("_export_history", EXPORT_HISTORY_SQL, events=self.table("events"))
