import random

import pytest
from pyspark.sql import functions as F

from packloom.functions import paths as P
from packloom.functions import text as T


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize("text,numbered", [
    ("", "1: "), ("a", "1: a"), ("a\n", "1: a\n2: \n"), ("a\r\nb\rc", "1: a\n2: b\n3: c"),
    ("\n".join("x" * 10), "\n".join(f"{i:>2}: x" for i in range(1, 11))),
])
def test_number_lines(spark, text, numbered):
    assert one(spark, text, T.number_lines) == numbered


def brute_binary(data: bytes) -> bool:
    """Byte-by-byte restatement of the rule."""
    data = data[:1024]
    for bom in (b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff"):
        if data.startswith(bom):
            data = data[len(bom):]
            break
    if not data:
        return False
    if 0 in data:
        return True
    bad = i = 0
    while i < len(data):
        b = data[i]
        follow = 1 if 0xC0 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF7 else 0
        if b <= 0x7F:
            bad += b < 32 and b not in (9, 10, 13)
            i += 1
        elif follow and i + follow < len(data) and all(0x80 <= x <= 0xBF for x in data[i + 1:i + 1 + follow]):
            i += 1 + follow
        else:
            bad += 1
            i += 1
    return bad / len(data) > 0.30


def test_binary_content(spark):
    rng = random.Random(3)
    cases = [b"", b"plain", b"\xef\xbb\xbf", b"\xff\xfea\0", "grün".encode() * 300, b"\x80" * 4 + b"a" * 6, b"\x80" * 3 + b"a" * 7, "é".encode()]
    pool = [b"a", b"\n", b"\x01", b"\x80", b"\xff", "é".encode(), "世".encode(), "😀".encode(), b"\xc3", b"\xe4\xb8"]
    for _ in range(800):
        cases.append(b"".join(rng.choices(pool, weights=[rng.random() for _ in pool], k=rng.randint(1, 700))))
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, b binary")
    got = {r.i: r.x for r in df.select("i", T.is_binary_content(F.col("b")).alias("x")).collect()}
    wrong = [i for i, c in enumerate(cases) if got[i] != brute_binary(c)]
    assert not wrong and 20 < sum(got.values()) < len(cases) - 20


@pytest.mark.parametrize("path,line", [
    ("src/a.kt", "// filename: src/a.kt"), ("a/B.PY", "# filename: a/B.PY"), ("x/i.html", "<!-- filename: x/i.html -->"),
    ("q.sql", "-- filename: q.sql"), ("s/a.css", "/* filename: */s/a.css"), ("d/Dockerfile", "# filename: d/Dockerfile"),
    ("MAKEFILE", "# filename: MAKEFILE"), ("noext", "// filename: noext"), ("b.bat", "REM filename: b.bat"),
])
def test_header_line(spark, path, line):
    def expr(p):
        name = P.base_name(p)
        return T.header_line(p, P.extension(name), name)

    assert one(spark, path, expr) == line


@pytest.mark.parametrize("text,has", [
    ("// filename: a", True), ("# filename: a", True), ("/* filename: */a", True), ("  <!-- filename: a -->", True),
    ("x // filename: a", False), ("1: // filename: a", False), ("", False),
])
def test_has_header(spark, text, has):
    assert one(spark, text, T.has_header) is has


@pytest.mark.parametrize("path,hint", [
    ("a/b.kt", "kotlin"), ("a/b.unknown", "text"), ("Dockerfile", "dockerfile"), ("a.b/Dockerfile", "text"), ("x/MAKEFILE", "makefile"), ("a.PY", "python"),
])
def test_fence_hint(spark, path, hint):
    assert one(spark, path, T.fence_hint) == hint


@pytest.mark.parametrize("n,history,notice", [
    (0, "0.0 KB", "0.0KB"), (1536, "1.5 KB", "1.5KB"), (1048576, "1.0 MB", "1.0MB"), (12544, "12.3 KB", "12.3KB"), (1048575, "1024.0 KB", "1024.0KB"),
])
def test_sizes(spark, n, history, notice):
    assert one(spark, n, T.history_size, "bigint") == history
    assert one(spark, n, T.notice_size, "bigint") == notice


def test_export_line(spark):
    df = spark.createDataFrame([(3, 2048, 12345)], "f int, b bigint, t bigint")
    assert df.select(T.export_line(F.col("f"), F.col("b"), F.col("t"))).first()[0] == "3 files, 2.0 KB, ~12,345 tokens"


@pytest.mark.parametrize("filter_text,valid", [(".kt", True), ("kt", True), ("", False), ("*.kt", False), (".a b", False)])
def test_filter_format(spark, filter_text, valid):
    assert one(spark, filter_text, T.is_valid_filter) is valid


@pytest.mark.parametrize("directory,ref,out", [
    ("a/b", "./c.ts", "a/b/c.ts"), ("a/b", "../c", "a/c"), ("a/b", "../../c", "c"), ("a", "../../c", None), ("", "x//y/./z", "x/y/z"), ("a/b", "../..", ""),
])
def test_resolve_relative(spark, directory, ref, out):
    df = spark.createDataFrame([(directory, ref)], "d string, r string")
    assert df.select(P.resolve_relative(F.col("d"), F.col("r"))).first()[0] == out


def test_path_columns(spark):
    df = spark.createDataFrame([("a/b.test.ts",), ("Dockerfile",), (".env",)], "path string")
    rows = {r.path: (r.name, r.stem, r.ext, r.dir) for r in P.with_path_columns(df).collect()}
    assert rows == {
        "a/b.test.ts": ("b.test.ts", "b.test", "ts", "a"), "Dockerfile": ("Dockerfile", "Dockerfile", None, ""), ".env": (".env", "", "env", ""),
    }


def test_normalize_and_relative(spark):
    df = spark.createDataFrame([("C:\\w\\r\\a\\b.kt",), ("C:\\w\\r",), ("other/x",)], "p string")
    got = [r[0] for r in df.select(P.normalize_path(F.col("p"), F.lit("C:\\w\\r\\"))).collect()]
    assert got == ["a/b.kt", "", "other/x"]


def test_read_text(spark):
    df = spark.createDataFrame([(bytearray("grün".encode()),), (bytearray(b"a\xffb"),), (None,)], "b binary")
    got = [r[0] for r in df.select(T.read_text(F.col("b"), F.lit("p"))).collect()]
    assert got == ["grün", "a\ufffdb", "// Error reading file: p"]


def test_escape_xml(spark):
    assert one(spark, "<a b=\"'&\">", T.escape_xml) == "&lt;a b=&quot;&apos;&amp;&quot;&gt;"


@pytest.mark.parametrize("text,low,high", [("", 0, 0), ("Hello world", 2, 4), ("fun main() { println(1) }", 8, 16)])
def test_tokens_in_range(spark, text, low, high):
    assert low <= one(spark, text, T.approx_tokens) <= high
