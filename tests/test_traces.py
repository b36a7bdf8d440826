import random
import re

import pytest
from pyspark.sql import functions as F

from packloom import constants as K
from packloom.config import PLAIN_FOLD, FoldConfig
from packloom.operators import traces

OWN = "com.acme.shop.Cart"


def at(cls, n):
    return f"\tat {cls}.run(Src.java:{n})"


def brute_fold(text: str, own: set[str], c: FoldConfig) -> str:
    """Line-by-line restatement of the rules."""
    lines = re.split("\r\n|\n|\r", text)
    solid = [x for x in lines if x.strip()]
    if len(lines) < c.min_frames or not solid:
        return text

    def parse(line):
        if re.match(K.CAUSED_BY_PATTERN, line.strip()) or re.match(K.SUPPRESSED_PATTERN, line.strip()):
            return False, None
        m = re.match(K.FRAME_PATTERN, line)
        if m:
            name = m.group(1)
            plain = name.split("/")[-1]
            if plain.startswith(tuple(c.never_fold)):
                return False, name
            return plain.startswith(tuple(c.always_fold)) or name not in own, name
        return bool(re.match(K.ELLIPSIS_PATTERN, line.strip())) and c.fold_ellipsis, None

    parsed = [(x, *parse(x)) for x in solid]
    out, i = [], 0
    while i < len(parsed):
        j = i
        while j < len(parsed) and parsed[j][1]:
            j += 1
        run = parsed[i:j]
        if not run:
            out.append(parsed[i][0])
            i += 1
            continue
        head = min(c.keep_head, len(run))
        tail = min(c.keep_tail, len(run) - head)
        gone = run[head:len(run) - tail]
        if len(run) < c.min_frames or not gone:
            out += [r[0] for r in run]
        else:
            out += [r[0] for r in run[:head]]
            indent = re.match(r"[ \t]*", run[0][0]).group(0) if c.preserve_indent else "    "
            counts = {}
            for _, _, name in gone:
                plain = (name or "").split("/")[-1]
                if "." in plain:
                    seg = plain.rsplit(".", 1)[0].split(".")
                    top = ".".join(seg[:2]) if seg[0] in ("org", "com") and len(seg) > 1 else seg[0]
                    counts[top] = counts.get(top, 0) + 1
            hints = ", ".join(f"{k}.*({v})" for k, v in sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:3])
            note = f" ({hints})" if c.package_hints and hints else ""
            out.append(f"{indent}... {len(gone)} folded frames{note} ...")
            out += [r[0] for r in run[len(run) - tail:]] if tail else []
        i = j
    return "\n".join(out)


def fold(spark, texts, own, config):
    df = spark.createDataFrame(list(enumerate(texts)), "trace_id bigint, text string")
    classes = spark.createDataFrame([(c,) for c in own] or [("none",)], "class_name string")
    got = traces.fold_traces(traces.raw_lines(df), classes, config).collect()
    return [t for _, t in sorted((r.trace_id, r.text) for r in got)]


SCENARIOS = [
    # a run of four folds, a run of two stays
    (["E: x", at("com.lib.A", 1), at("com.lib.B", 2), at("java.util.List", 3), at("java.util.Map", 4), at(OWN, 5), at("org.spring.A", 6), at("org.spring.B", 7), at(OWN, 8)],
     ["E: x", "    ... 4 folded frames ...", at(OWN, 5), at("org.spring.A", 6), at("org.spring.B", 7), at(OWN, 8)]),
    (["E: x", at("java.util.List", 3), at(OWN, 5)], None),
    (["E: x", at(OWN, 1), at(OWN, 2), at(OWN, 3)], None),
    (["E: x", at("a.B", 1), at("a.C", 2), at("a.D", 3)], ["E: x", "    ... 3 folded frames ..."]),
    # a cause splits runs; native and unknown sources are frames
    (["E: x", at("a.B", 1), at("a.C", 2), "Caused by: F: y", at("java.io.File", 1), "\tat sun.nio.X.open(Native Method)", "\tat sun.nio.X.<init>(Unknown Source)", at(OWN, 1)],
     ["E: x", at("a.B", 1), at("a.C", 2), "Caused by: F: y", "    ... 3 folded frames ...", at(OWN, 1)]),
    # an ellipsis counts as a frame
    (["E: x", at("a.B", 1), at("a.C", 2), "\t... 5 more", at(OWN, 1)], ["E: x", "    ... 3 folded frames ...", at(OWN, 1)]),
    # blank lines vanish, other lines split
    (["E: x", "", "some log", at("a.B", 1), "  ", at("a.C", 2), at("a.D", 3), "\tWARN: w", at(OWN, 1)],
     ["E: x", "some log", "    ... 3 folded frames ...", "\tWARN: w", at(OWN, 1)]),
    # never-fold prefix wins, module prefixes are ignored for prefixes
    ([at("org.springframework.test.context.A", 1), at("java.base/java.util.A", 2), at("java.base/java.util.B", 3), at("java.base/java.util.C", 4)],
     [at("org.springframework.test.context.A", 1), "    ... 3 folded frames ..."]),
    (["", " "], ["", " "]),
    (["\tSuppressed: G: z", at("a.B", 1), at("a.C", 2), at("a.D", 3)], ["\tSuppressed: G: z", "    ... 3 folded frames ..."]),
]


def test_scenarios(spark):
    texts = ["\n".join(lines) for lines, _ in SCENARIOS]
    want = ["\n".join(out if out is not None else lines) for lines, out in SCENARIOS]
    assert fold(spark, texts, {OWN}, PLAIN_FOLD) == want
    assert [brute_fold(t, {OWN}, PLAIN_FOLD) for t in texts] == want


def test_higher_threshold(spark):
    text = "\n".join(SCENARIOS[0][0])
    assert fold(spark, [text], {OWN}, FoldConfig(min_frames=5, keep_head=0, keep_tail=0, package_hints=False)) == [text]


@pytest.mark.parametrize("config", [PLAIN_FOLD, FoldConfig(), FoldConfig(keep_head=2, keep_tail=3, min_frames=2, fold_ellipsis=True), FoldConfig(keep_head=9)])
def test_random_traces_against_brute_force(spark, config, monkeypatch):
    monkeypatch.setattr(traces, "SLICE_LINES", 5)  # runs cross slices
    rng = random.Random(11)
    pool = [at(OWN, 1), at("java.util.A", 2), at("com.lib.x.B", 3), at("org.y.C", 4), "  at zed.D.go(Native Method)", "\t... 3 more", "", "Caused by: E: x", "log", at("Plain", 1)]
    texts = ["\n".join(rng.choices(pool, weights=[2, 6, 5, 5, 3, 2, 1, 1, 1, 2], k=rng.randint(1, 40))) for _ in range(80)]
    assert fold(spark, texts, {OWN}, config) == [brute_fold(t, {OWN}, config) for t in texts]


def test_one_trace_holding_most_lines(spark):
    """A run over many slices; every line that does not fold survives."""
    n = 30000
    lines = spark.range(n).select(
        F.lit(1).cast("bigint").alias("trace_id"), F.col("id").alias("line_no"),
        F.when(F.col("id") == 20000, F.lit(at(OWN, 1))).otherwise(F.lit(at("java.util.A", 2))).alias("line"),
    )
    classes = spark.createDataFrame([(OWN,)], "class_name string")
    got = [r.line for r in traces.fold_lines(lines, classes, PLAIN_FOLD).orderBy("line_no").collect()]
    assert got == ["    ... 20000 folded frames ...", at(OWN, 1), "    ... 9999 folded frames ..."]


def test_runs_over_slices_against_brute_force(spark, monkeypatch):
    """Slices of two lines: runs that begin before, end after, and fill slices; blank slices; own indents."""
    monkeypatch.setattr(traces, "SLICE_LINES", 2)
    rng = random.Random(23)
    pool = ["  " * rng.randint(0, 3) + at(c, 1).strip() for c in ["java.util.A", "com.lib.B", "org.y.C"] * 4] + ["", "log", at(OWN, 1)]
    texts = ["\n".join(rng.choices(pool, weights=[6] * 12 + [8, 2, 1], k=rng.randint(1, 60))) for _ in range(120)]
    config = FoldConfig(min_frames=2, fold_ellipsis=True)
    assert fold(spark, texts, {OWN}, config) == [brute_fold(t, {OWN}, config) for t in texts]


def test_raw_is_appended(spark):
    text = "E: x\n" + "\n".join(at("a.B", i) for i in range(3))
    df = spark.createDataFrame([(1, text)], "trace_id bigint, text string")
    row = traces.fold_and_emit(traces.raw_lines(df), spark.createDataFrame([("q",)], "class_name string")).first()
    assert row.text == f"E: x\n{at('a.B', 0)}\n\t... 1 folded frames (a.*(1)) ...\n{at('a.B', 2)}\n{K.RAW_TRACE_MARKER}\n{text}"
    assert row.chars == len(row.text) and row.tokens > 0
