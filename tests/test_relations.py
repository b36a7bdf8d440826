import random
import re

import pytest
from pyspark.sql import functions as F

from packloom.operators import graph, imports, inherit, relate
from packloom.plans import exports
from tests.conftest import paths


def edges(df):
    return sorted((r.src, r.dst) for r in df.collect())


def resolved(corpus, files):
    return edges(imports.import_edges(corpus(files)))


def test_script_resolution_order(corpus):
    files = {
        "src/a.ts": "import x from './b'\nimport './c.css'\nconst d = require('../lib/d')\nimport('./e')\nexport * from './f'",
        "src/b.js": "", "src/b.ts": "", "src/c.css": "", "lib/d/index.ts": "", "lib/d/index.jsx": "", "src/e.mjs": "", "src/f.json": "",
    }
    # a directory of that name is found before its index file
    assert resolved(corpus, files) == [
        ("src/a.ts", "lib/d"), ("src/a.ts", "src/b.js"), ("src/a.ts", "src/c.css"), ("src/a.ts", "src/e.mjs"), ("src/a.ts", "src/f.json"),
    ]


def test_script_roots_and_alias(corpus):
    files = {
        "app/x/a.tsx": "import a from 'widgets/w'\nimport b from '@/util/u'\nimport c from 'react'\nimport d from 'utils2'",
        "components/widgets/w.jsx": "", "lib/widgets/w.js": "", "src/util/u.ts": "", "util/u.ts": "",
    }
    assert resolved(corpus, files) == [("app/x/a.tsx", "components/widgets/w.jsx"), ("app/x/a.tsx", "src/util/u.ts")]


def test_alias_without_src_uses_the_root(corpus):
    assert resolved(corpus, {"a.ts": "import b from '@/util/u'", "util/u.ts": ""}) == [("a.ts", "util/u.ts")]


def test_jvm_resolution(corpus):
    files = {
        "src/main/java/p/A.java": "import p.q.B;\nimport static p.C_x;\nimport p.*;\nimport java.util.List;",
        "src/main/kotlin/p/q/B.kt": "", "src/p/q/B.java": "", "src/main/java/p/Cx.java": "", "src/main/java/p/K.kt": "import p.A",
    }
    assert resolved(corpus, files) == [
        ("src/main/java/p/A.java", "src/main/java/p"),  # a wildcard hits the directory
        ("src/main/java/p/A.java", "src/main/java/p/Cx.java"),
        ("src/main/java/p/A.java", "src/main/kotlin/p/q/B.kt"),
        ("src/main/java/p/K.kt", "src/main/java/p/A.java"),
    ]


def test_python_html_css_resolution(corpus):
    files = {
        "m.py": "from a.b import c\nimport pkg\nimport x, y", "a/b.py": "", "pkg/__init__.py": "", "x.py": "",
        "w/i.html": "<script src='js/app.js'></script><link rel=s href=\"../s/m.css\"><script src='/abs.js'></script>",
        "w/js/app.js": "", "s/m.css": "@import 'base';\n@import url(theme.css);", "s/base.scss": "", "s/theme.css": "", "abs.js": "",
    }
    assert resolved(corpus, files) == [
        ("m.py", "a/b.py"), ("m.py", "pkg/__init__.py"), ("s/m.css", "s/base.scss"), ("s/m.css", "s/theme.css"),
        ("w/i.html", "s/m.css"), ("w/i.html", "w/js/app.js"),
    ]


CHAIN = {"a.ts": "import './b'", "b.ts": "import './c'\nimport './a'", "c.ts": "import './d'", "d.ts": "import './b'", "e.ts": ""}


def test_direct_and_transitive(spark, corpus, select):
    table = imports.import_edges(corpus(CHAIN))
    start = select("a.ts")
    assert paths(graph.direct_imports(start, table)) == ["b.ts"]
    got = {r.path: r.depth for r in graph.transitive_imports(start, table).collect()}
    assert got == {"b.ts": 1, "c.ts": 2, "d.ts": 3}
    assert paths(graph.transitive_imports(start, table, max_depth=2)) == ["b.ts", "c.ts"]
    capped = graph.transitive_imports(start, table, cap=2)
    assert paths(capped) == ["b.ts", "c.ts"]
    assert exports.truncated(capped, 2).first().truncated


def test_closure_on_random_graphs(spark):
    rng = random.Random(5)
    pairs = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)}
    table = spark.createDataFrame([("r", a, b) for a, b in pairs], "repo string, src string, dst string")
    start = spark.createDataFrame([(i, "r", f"n{i}") for i in range(6)], "export_id bigint, repo string, path string")
    got = {(r.export_id, r.path, r.depth) for r in graph.closure(start, table).collect()}
    want = set()
    for i in range(6):
        seen, front, depth = {f"n{i}": 0}, {f"n{i}"}, 0
        while front:
            depth += 1
            front = {b for a, b in pairs if a in front} - set(seen)
            seen.update({p: depth for p in front})
        want |= {(i, p, d) for p, d in seen.items()}
    assert got == want


def test_closure_of_a_long_chain_keeps_a_short_plan(spark):
    n = 40
    table = spark.createDataFrame(
        [("r", f"n{i}", f"n{i + 1}") for i in range(n)] + [("r", f"n{n}", "n0")], "repo string, src string, dst string")
    start = spark.createDataFrame([(0, "r", "n0"), (1, "r", "n5")], "export_id bigint, repo string, path string")
    got = graph.closure(start, table)
    assert {(r.export_id, r.path): r.depth for r in got.collect()} == {
        (e, f"n{(s + d) % (n + 1)}"): d for e, s in [(0, 0), (1, 5)] for d in range(n + 1)}
    assert got.count() == 2 * (n + 1)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 4
    assert sorted(r.depth for r in graph.closure(start, table, max_depth=6).where("export_id = 1").collect()) == list(range(7))
    assert sorted(r.depth for r in graph.closure(start, table, max_depth=0).collect()) == [0, 0]


def test_term_filter_lets_every_wanted_term_through(spark):
    wanted = spark.createDataFrame([("r", f"w{i}") for i in range(500)] + [("q", ""), ("q", "\u00e9")], "repo string, term string")
    words = graph.term_filter(wanted).first().words
    assert len(words) == graph.FILTER_WORDS and 0 < sum(w != 0 for w in words) <= 502
    at, bits = graph._place(F.col("repo"), F.col("term"))
    for repo, term, at, bits in wanted.select("repo", "term", at, bits).collect():
        assert words[at] & bits == bits, (repo, term)
    assert not any(graph.term_filter(wanted.where("false")).first().words)


def test_candidates_against_the_plain_search(spark, corpus, select):
    rng = random.Random(9)
    stems = ["foo", "foo.test", "my-file", "a.b.c", "x_y", "wide   gap", "-lead", "Bar"]
    pieces = ["foo", "foo.test", "my-file", "my-files", "a.b.c", "a.b", "x_y", "x_yz", "wide   gap", "z-lead", " ", "(", "Bar", "bar", "/", "."]
    files = {f"src/{s}.ts": "" for s in stems}
    for i in range(60):
        files[f"t/u{i}.ts"] = "".join(rng.choices(pieces, k=8))
    got = {(r.export_id, r.path) for r in graph.dependents_candidates(
        select("src/foo.ts", export_id=0).unionByName(
            spark.createDataFrame([(i, "r", 0, f"src/{s}.ts", False) for i, s in enumerate(stems) if i], "export_id bigint, repo string, root_ordinal int, path string, is_dir boolean")
        ), corpus(files)).collect()}
    want = {(i, p) for i, s in enumerate(stems) for p, text in files.items()
            if p != f"src/{s}.ts" and re.search(r"\b" + re.escape(s) + r"\b", text, re.ASCII)}
    assert got == want


def test_dependents_and_both_directions(corpus, select):
    files = corpus({
        "a.ts": "import './util'", "util.ts": "import './base'", "base.ts": "", "b.ts": "import './util'\nimport './other'", "other.ts": "",
        "node_modules/c.ts": "import '../util'", "note.md": "util", "d.ts": "// util",
    })
    table = imports.import_edges(files)
    start = select("util.ts")
    assert paths(graph.dependents_candidates(start, files)) == ["a.ts", "b.ts", "d.ts"]
    assert paths(graph.dependents(start, files, table)) == ["a.ts", "b.ts"]
    assert paths(graph.dependents(start, files, table, cap=1)) == ["a.ts"]
    assert paths(graph.bidirectional(start, files, table)) == ["a.ts", "b.ts", "base.ts", "other.ts"]
    assert paths(graph.bidirectional(start, files, table, transitive=False)) == ["a.ts", "b.ts", "base.ts"]
    lonely = exports.export_bidirectional(files, select("note.md"), edges=table)
    assert lonely.entries.count() == 0


BRUTE = {
    "CLASS": lambda n: rf"class\s+[A-Z][a-zA-Z0-9_]*\s+extends\s+{n}(?:\s|<|,|\{{)",
    "ABSTRACT_CLASS": lambda n: rf"class\s+[A-Z][a-zA-Z0-9_]*\s+extends\s+{n}(?:\s|<|,|\{{)",
    "INTERFACE": lambda n: rf"(?:implements|extends)\s+(?:[^,\s{{]*,\s*)*{n}(?:\s|<|,|\{{)",
}


def test_subtypes_against_the_plain_search(corpus, select):
    files = {
        "base/W.ts": "export abstract class Base {\n}\nexport interface Shape {}\nexport interface Other extends Shape {}\nexport const Box = (p) => <div/>",
        "x/a.ts": "class A extends Base {", "x/b.ts": "class B extends Base<T> implements Other, Shape {", "x/c.ts": "class C extends Based {",
        "x/d.ts": "interface D extends Other,Shape{", "x/e.ts": "class E implements Shape", "x/f.tsx": "memo( Box )", "x/g.tsx": "const G = (p) => <BoxWide/>",
        "x/h.ts": "class H implements X<Y>, Shape {", "x/__tests__/i.ts": "class I extends Base {", "x/j.py": "class J extends Base {", "x/k.ts": "class K extends Base",
    }
    got = paths(inherit.implementations(select("base/W.ts"), corpus(files)))
    want = set()
    for name, kind in (("Base", "CLASS"), ("Shape", "INTERFACE"), ("Other", "INTERFACE")):
        want |= {p for p, t in files.items() if p != "base/W.ts" and p.endswith(("ts", "tsx")) and re.search(BRUTE[kind](name), t)}
    assert got == sorted(want | {"x/f.tsx", "x/g.tsx"})
    assert "x/__tests__/i.ts" not in paths(inherit.implementations(select("base/W.ts"), corpus(files), include_tests=False))
    assert paths(inherit.implementations(select("base/W.ts"), corpus(files), names=["Other"])) == ["x/b.ts", "x/d.ts"]
    stats = inherit.implementation_stats(select("base/W.ts"), corpus(files)).first()
    # an abstract class counts as class and as abstract class
    assert (stats.interfaces, stats.abstract_or_open, stats.concrete, stats.components) == (2, 1, 1, 1)


def test_stats_text(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 1, 0), (2, 1, 3)], "i int, a int, r int")
    got = [r[0] for r in df.select(inherit.stats_text(F.col("i"), F.col("a"), F.col("r"))).collect()]
    assert got == ["No inheritable types", "1 interface", "2 interfaces and 1 abstract/open class", "2 interfaces, 1 abstract/open class and 3 React components"]


def test_jvm_subtypes_transitively(corpus, select):
    files = corpus({
        "A.kt": "interface A\nopen class Plain", "B.kt": "open class B(val x: Int) : A, Other<Thing>() {", "C.java": "public class C extends B {", "D.java": "class D implements Runnable {",
        "E.kt": "class E : Plain()",
    })
    assert paths(inherit.jvm_implementations(select("A.kt"), files)) == ["B.kt", "C.java", "E.kt"]
    found = exports.export_implementations_of(files, ["B"])
    assert paths(found.entries) == ["B.kt", "C.java"]


def test_jvm_subtypes_leave_arguments_and_neighbours_out(corpus, select):
    files = corpus({
        "User.kt": "open class User", "Repo.kt": "interface Repo : CrudRepository<User, Map<String, List<User>>>",
        "Free.kt": "class Free : Base()\nfun foo(x: User) = 1", "Held.kt": "class Held(val u: User = make(f(1))) : Base(User()) {",
        "Admin.kt": "class Admin @Inject constructor(val b: (User) -> Int) :\n  Base<User>(), a.b.User(1), Other by other {",
        "Root.java": "public class Root<T extends Free> extends Admin implements X, Y {",
    })
    assert paths(inherit.jvm_implementations(select("User.kt"), files)) == ["Admin.kt", "Root.java"]


def test_jvm_subtypes_behind_arguments_of_any_depth(corpus, select):
    """Twenty levels of calls and types before the super-type; comparisons and open brackets are no arguments."""
    calls, types = "f(" * 20 + ")" * 20, "M<" * 20 + "T" + ">" * 20
    files = corpus({
        "Top.kt": "interface Top", "Calls.kt": f"class Calls(val x: Int = {calls}) : Base<{types}>({calls}), Top", "Types.java": f"class Types<A extends {types}> implements X<{types}>, Top {{",
        "Both.kt": "class Both : G<" + "(" * 30 + "User" + ")" * 30 + ">(), Top", "Open.kt": "val a = ((((((((((((b < c\nclass Open : Other(), Top",
        "Not.kt": f"class Not(val t: Top = {calls}) : Base({calls})",
    })
    assert paths(inherit.jvm_implementations(select("Top.kt"), files)) == ["Both.kt", "Calls.kt", "Open.kt", "Types.java"]


def test_jvm_subtypes_follow_names_not_files(corpus):
    files = corpus({
        "Two.kt": "open class A\nopen class Z", "X.kt": "open class X : A()\nopen class Q", "W.kt": "class W : Z()", "Y.kt": "class Y : Q()", "V.kt": "class V : X()",
    })
    assert paths(exports.export_implementations_of(files, ["A"]).entries) == ["Two.kt", "V.kt", "X.kt"]


def test_words_of_any_script(spark, corpus, select):
    files = corpus({"日本.ts": "", "b.ts": "use 日本 here", "c.ts": "日本語", "na.ts": "", "d.ts": "naïve", "e.ts": "(na)", "$.ts": "", "f.ts": "a$b", "g.ts": "a $b"})
    assert paths(graph.dependents_candidates(select("日本.ts"), files)) == ["b.ts"]
    assert paths(graph.dependents_candidates(select("na.ts"), files)) == ["e.ts"]
    assert paths(graph.dependents_candidates(select("$.ts"), files)) == ["f.ts"]


def test_tests_by_name_and_folder(corpus, select):
    files = corpus({p: "" for p in [
        "s/User.kt", "t/UserTest.kt", "t/UserIT.kt", "t/TestUser.kt", "t/UserTest.java", "s/btn.tsx", "q/btn.test.js", "q/btn.ts",
        "s/__tests__/my-btn-x.js", "s/tests/BTN.ts", "s/btn-extra.spec.ts", "s/m.py", "s/test_m.py", "s/m_test.py", "s/README", "t/READMETest.",
    ]})
    assert paths(relate.related_tests(select("s/User.kt"), files)) == ["t/TestUser.kt", "t/UserIT.kt", "t/UserTest.kt"]
    assert paths(relate.related_tests(select("s/btn.tsx"), files)) == [
        "q/btn.test.js", "q/btn.ts", "s/__tests__/my-btn-x.js", "s/btn-extra.spec.ts", "s/btn.tsx", "s/tests/BTN.ts",
    ]
    assert paths(relate.related_tests(select("s/m.py"), files)) == ["s/m_test.py", "s/test_m.py"]
    assert paths(relate.related_tests(select("s/README"), files)) == ["t/READMETest."]
    assert paths(exports.cap_related(relate.related_tests(select("s/User.kt"), files), 2)) == ["t/TestUser.kt", "t/UserIT.kt"]


def test_every_kind_of_test(corpus, select):
    files = corpus({p: "" for p in [
        "src/UserService.kt", "src/test/UserServiceTest.kt", "it/UserServiceIT.kt", "src/test/myuserservicex.kt", "src/test/UserServiceE2E.kt",
        "src/test/fixtures/users.json", "src/fixtures/no.json", "lib/TestBase.kt", "src/Commit.kt", "src/test/LoadTest.java",
    ]})
    related = relate.all_related_tests(select("src/UserService.kt"), files)
    assert paths(related) == [
        "it/UserServiceIT.kt", "lib/TestBase.kt", "src/test/UserServiceE2E.kt", "src/test/UserServiceTest.kt",
        "src/test/fixtures/users.json", "src/test/myuserservicex.kt",
    ]
    assert relate.test_categories(related).first().text == "All Tests Export (3 unit, 1 integration, 1 E2E, 1 resources)"
    # the name test ignores case, so Commit ends in "it"
    assert "src/Commit.kt" in paths(relate.all_test_files(files))
    assert exports.export_all_tests(files, select("src/UserService.kt"))[0].entries.count() == 7


def test_substring_join_against_the_plain_search(spark, corpus):
    rng = random.Random(2)
    names = ["".join(rng.choices("abA", k=rng.randint(1, 6))) for _ in range(40)]
    files = {f"src/test/{n}{i}.js": "" for i, n in enumerate(names)}
    files |= {f"s{i}/{n[:2]}.js": "" for i, n in enumerate(names[:15])}
    sel = spark.createDataFrame([(i, "r", 0, p, False) for i, p in enumerate(p for p in files if p.startswith("s") and not p.startswith("src"))], "export_id bigint, repo string, root_ordinal int, path string, is_dir boolean")
    got = {(r.export_id, r.path) for r in relate.tests_in_test_dirs(sel, corpus(files)).collect()}
    want = {(r.export_id, p) for r in sel.collect() for p in files if p.startswith("src/test/")
            and r.path.split("/")[-1][:-3].lower() in p.split("/")[-1][:-3].lower()}
    assert got == want


def test_resources(corpus, select):
    files = corpus({
        "c/Home.java": "@Controller class H { String a() { return \"home\"; } String b() { return \"users/list\"; } }",
        "v/home.html": "", "v/home.ftl": "", "v/list.html": "", "u/Card.tsx": "import React from 'react'", "z/Card.module.scss": "", "z/Card.css": "",
        "n/app.component.ts": "@Component({templateUrl: './app.component.html', styleUrls: ['./a.css',\n '../n/b.scss']})",
        "n/app.component.html": "", "n/a.css": "", "n/b.scss": "", "k/load.js": "fetch('data/x.json'); open(\"missing/y.yml\")", "k/data/x.json": "", "o/x.json": "", "o/y.yml": "", "p/y.yml": "",
        "q/view.vue": "", "w/view.less": "", "e/Thing.ts": "", "f/Thing.properties": "",
    })
    def found(p):
        return paths(relate.related_resources(select(p), files))
    assert found("c/Home.java") == ["v/home.ftl", "v/home.html"]
    assert found("u/Card.tsx") == ["z/Card.css", "z/Card.module.scss"]
    assert found("n/app.component.ts") == ["n/a.css", "n/app.component.html", "n/b.scss"]
    assert found("k/load.js") == ["k/data/x.json", "o/y.yml", "p/y.yml"]
    assert found("q/view.vue") == ["w/view.less"]
    assert found("e/Thing.ts") == ["f/Thing.properties"]
    own = lambda s, f: s.select("repo", F.col("path").alias("src"), F.lit("o/x.json").alias("dst"))
    assert paths(relate.related_resources(select("e/Thing.ts"), files, [own])) == ["o/x.json"]
    assert exports.export_resources(files, select("v/list.html")).entries.count() == 0


def test_configs_and_peers(corpus, select):
    files = corpus({p: "x" for p in ["package.json", "tsconfig.json", "a/tsconfig.json", "a/b.ts", "a/c.py", "a/tox.ini", "b/package.json", "a/Dockerfile", "a/d/e.ts"]})
    assert paths(relate.config_files(select("a/b.ts"), files)) == ["a/Dockerfile", "a/tsconfig.json", "package.json", "tsconfig.json"]
    assert paths(relate.config_files(select("a/c.py"), files)) == ["a/Dockerfile", "a/tox.ini", "package.json"]
    assert paths(relate.package_peers(select("a/b.ts"), files)) == ["a/Dockerfile", "a/c.py", "a/tox.ini", "a/tsconfig.json"]
    assert paths(relate.package_peers(select("a/b.ts", "a/c.py"), files)) == ["a/Dockerfile", "a/b.ts", "a/c.py", "a/tox.ini", "a/tsconfig.json"]


def test_best_repo(spark, select):
    repos = spark.createDataFrame([("r", "one", "u1"), ("r", "two", "u2")], "repo string, repo_root string, url string")
    assert relate.best_repo(select("one/a", "two/b", "two/c", "out/d"), repos).first().url == "u2"
    assert relate.best_repo(select("one/a", "two/b"), repos).first().url == "u1"


def test_names_holding_a_part_against_the_plain_search(spark):
    rng = random.Random(11)
    word = lambda low, high: "".join(rng.choices("abé", k=rng.randint(low, high)))
    asked = [(i % 7, rng.choice("rq"), rng.choice(["x", "y", None]), word(1, 6)) for i in range(120)]
    named = [(rng.choice("rq"), rng.choice(["x", "y", None]), f"p{i}", word(1, 9)) for i in range(150)]
    got = relate._containing(
        spark.createDataFrame(asked, "export_id bigint, repo string, ext string, part string").distinct(),
        spark.createDataFrame(named, "repo string, ext string, path string, name string"), ["repo", "ext"],
    ).distinct().collect()
    assert {tuple(r) for r in got} == {
        (e, r, p) for e, r, x, part in asked for q, y, p, name in named if r == q and x == y and x is not None and part in name}


def test_pieces_are_chosen_before_pairs_are_made(corpus, select):
    """The plan that makes the pairs holds no sorts and aggregates of the choice of pieces."""
    files = {"src/Order.java": "", "src/test/OrderCase.java": "", "src/test/BigOrderTest.java": "", "src/test/Other.java": ""}
    found = relate.tests_in_test_dirs(select("src/Order.java"), corpus(files))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min(struct" not in plan and "AS hits" not in plan
    assert paths(found) == ["src/test/BigOrderTest.java", "src/test/OrderCase.java"]
