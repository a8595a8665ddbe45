import random

from lodestone.llm import provenance as P

SCHEMA = "chunk_id bigint, repo string, file_path string, content string"


def hand(rng):
    lines = []
    for _ in range(rng.randrange(8, 30)):
        lines.append(rng.choice(["    if {0} is None:\n        return {1}", "    {0} = self.{1}({2})", "    # keep {0} in step with {1}", "def {0}_{1}({2}, {0}):", "    for {0} in {1}:\n        {2}.append({0})"]).format(*(f"{rng.choice('load save open close merge'.split())}_{rng.choice('queue table index user page'.split())}{rng.randrange(30)}" for _ in range(3))))
    return "\n".join(lines)


def made(rng):
    return "\n".join(f"FIELD_{i} = Descriptor(name='f{i}', number={rng.randrange(900)}, type={rng.randrange(9)})" for i in range(rng.randrange(15, 60)))


def data(rng):
    return "T = [" + ", ".join(hex(rng.randrange(1 << 32)) for _ in range(rng.randrange(60, 300))) + "]"


def tables(n=60, seed=1):
    """Hand-written and generated files, copies in folders for them (a notice in every second one), minified files and data."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n // 2):
        for j, (path, text) in enumerate(((f"vendor/x{i}/a.py", ("# Copied verbatim from upstream.\n" if i % 2 else "") + hand(rng)), (f"web/a{i}.min.js", ("/*! x */" if i % 2 else "") + made(rng).replace("\n", ";")), (f"data/t{i}.py", data(rng)), (f"gen/x{i}/b_pb2.py", ("# Generated by y. DO NOT EDIT.\n" if i % 2 else "") + made(rng)))):
            rows.append((2000 + 10 * i + j, "r", path, text))
            truth[path] = True
    for i in range(n):
        rows.append((i, "r", f"src/hand{i}.py", f"# Copyright the r contributors.\n{hand(rng)}" if i % 2 else hand(rng)))
        truth[f"src/hand{i}.py"] = False
        rows.append((1000 + i, "r", f"src/made{i}.py", (f"# Code generated by tool{i}. DO NOT EDIT.\n" if i % 3 else "") + made(rng)))
        truth[f"src/made{i}.py"] = True
    return rows, truth


def verdicts(spark, rows):
    return {r["file_path"]: r["machine_made"] for r in P.machine_made(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_held_out_accuracy(spark):
    """A third of the generated files bear no notice; the forest has to see them by their features."""
    rows, truth = tables()
    got = verdicts(spark, rows)
    assert sum(got[p] == t for p, t in truth.items()) >= 0.95 * len(truth)


def test_the_forest_decides_what_bears_no_notice(spark):
    rows, truth = tables(seed=4)
    got = {r["file_path"]: r for r in P.machine_made(spark.createDataFrame(rows, SCHEMA)).collect()}
    silent = [p for p, t in truth.items() if t and not got[p]["notice"]]
    assert len(silent) > 60 and sum(got[p]["by_vote"] for p in silent) >= 0.95 * len(silent)
    assert all(r["machine_made"] == (bool(r["notice"]) or r["by_vote"]) and r["by_vote"] == (not r["notice"] and r["probability"] >= P.VOTE) for r in got.values())


def test_evidence(spark):
    rng = random.Random(2)
    code = hand(rng)
    blob = "T = [" + ", ".join(hex(rng.randrange(1 << 32)) for _ in range(200)) + "]"
    cases = {
        "vendor/x/a.py": (code, True),
        "vendors/a.py": (code, False),
        "external_api/a.py": (code, False),
        "gen/a.py": (code, True),
        "src/a_pb2.py": (code, True),
        "web/a.min.js": (code, True),
        "src/a_min_heap.js": (code, False),
        "src/copied.py": ("# Copied verbatim from upstream foo at tag v1.2.\n" + code, True),
        "src/foreign.py": ("# Copyright the foo contributors.\n" + code, True),
        "src/talk.py": ('    out.write("Code generated by x. DO NOT EDIT.")\n' + code, False),
        "src/todo.py": ("# TODO x: stop editing vendor/ by hand\n" + code, False),
        "src/de.py": ("# Diese Datei wurde maschinell erzeugt. Bitte nicht von Hand ändern.\n" + code, True),
        "data/blob.py": (blob, True),
        "src/short.py": (code + '\nkey = "' + "ab12" * 12 + '"', False),
        "src/empty.py": ("", False),
        "src/null.py": (None, False),
    }
    base, _ = tables(60)
    rows = base + [(5000 + i, "r", p, t) for i, (p, (t, _)) in enumerate(cases.items())]
    got = verdicts(spark, rows)
    assert {p: got[p] for p in cases} == {p: v for p, (_, v) in cases.items()}


def test_a_notice_in_any_chunk_and_repeated_rows(spark):
    rng = random.Random(3)
    rows = [(1, "r", "src/a.py", hand(rng)), (2, "r", "src/a.py", "// @generated by x\n"), (3, None, "src/b.py", hand(rng)), (3, None, "src/b.py", "x"), (4, "r", None, "x")]
    df = spark.createDataFrame(rows + rows[:1], SCHEMA).selectExpr("*", "1 AS notice", "2 AS label")
    got = {r["file_path"]: r for r in P.machine_made(df).collect()}
    assert set(got) == {"src/a.py", "src/b.py"}
    assert got["src/a.py"]["machine_made"] and not got["src/b.py"]["machine_made"]
    assert P.machine_made(df.limit(0)).count() == 0
    assert P.file_measures(df.where("chunk_id = 1")).collect() == P.file_measures(df.where("chunk_id = 1").distinct()).collect()


def test_notices_in_any_line():
    code = "a = 1\rb = 2\r"
    body = "f(x);" * 100
    generated = P._measured("// Code generated by tool. DO NOT EDIT.", "r")[-2]
    assert generated == 1
    assert P._measured("# one\r" + code + "# Code generated by tool. DO NOT EDIT.\r" + code, "r")[-2] == generated
    assert P._measured("a = 1\r# Code generated by tool. DO NOT EDIT.\r" + code, "r")[-2] == generated
    assert P._measured("// " + "- " * 300 + "Code generated by tool. DO NOT EDIT.\n", "r")[-2] == P._measured("// " + "- " * 30 + "Code generated by tool. DO NOT EDIT.\n", "r")[-2]
    behind = P._measured("/* Code generated by tool. DO NOT EDIT. */" + body, "r")
    assert behind[-2] == generated and behind[0] == len(body)
    assert P._measured("// a --> b */ " + "- " * 300 + "Code generated by tool. DO NOT EDIT.\n", "r")[-2] == 1
    # what stands behind a comment is code and no notice
    assert P._measured("/* one */" + body + "'// Code generated by tool. DO NOT EDIT.'", "r")[-2] == 0


def test_line_ends_do_not_count():
    text = "# Copyright the r contributors.\na = 1\n# why\nb = 2\n"
    assert P._measured(text, "r") == P._measured(text.replace("\n", "\r"), "r") == P._measured(text.replace("\n", "\r\n"), "r")
