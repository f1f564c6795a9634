import posixpath

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weighbridge.functions.paths import resolve_import

SEG = st.sampled_from(["a", "b", "docs", ".", "..", "", "x.md", "é"])


def model(importer: str, spec: str):
    """Resolve against the importer's directory inside the snapshot root; None if it leaves the root."""
    if spec.startswith("/"):
        return None
    d = posixpath.dirname(importer)
    out = []
    for seg in (f"{d}/{spec}" if d else spec).split("/"):
        if seg in ("", "."):
            continue
        if seg == "..":
            if not out:
                return None
            out.pop()
        else:
            out.append(seg)
    return "/".join(out) or None


@settings(max_examples=30, deadline=None)
@given(
    st.lists(st.tuples(st.lists(SEG, min_size=1, max_size=4), st.lists(SEG, min_size=1, max_size=5)), min_size=1, max_size=25)
)
def test_resolve_matches_model(spark, pairs):
    rows = [("/".join(i) + "/f.md", "/".join(s) + ".md") for i, s in pairs]
    df = spark.createDataFrame(rows, "imp string, spec string")
    got = [r[0] for r in df.select(resolve_import(F.col("imp"), F.col("spec"))).collect()]
    assert got == [model(i, s) for i, s in rows]


def test_resolve_cases(spark):
    cases = [
        ("pkg/CLAUDE.md", "../docs/n6.md", "docs/n6.md"),
        ("CLAUDE.md", "./a/./b.md", "a/b.md"),
        ("CLAUDE.md", "../up.md", None),
        ("a/b/CLAUDE.md", "/abs.md", None),
        ("a/b/CLAUDE.md", "..//../c.md", "c.md"),
    ]
    df = spark.createDataFrame([(i, s) for i, s, _ in cases], "imp string, spec string")
    got = [r[0] for r in df.select(resolve_import(F.col("imp"), F.col("spec"))).collect()]
    assert got == [w for _, _, w in cases]


def test_path_order_literal_rows_and_ties(spark):
    from tests.conftest import files_df
    from weighbridge import audit

    composed, decomposed = "dé/CLAUDE.md", "dé/CLAUDE.md"  # compare equal under ICU collation
    names = ["_z/CLAUDE.md", "A/CLAUDE.md", "a/CLAUDE.md", "B/CLAUDE.md", composed, decomposed, "e/CLAUDE.md", "z1/CLAUDE.md", "z10/CLAUDE.md", "z2/CLAUDE.md"]
    gone = files_df(spark, [(n, "@../shared.md\n@gone.md\n") for n in reversed(names)] + [("shared.md", "s" * 40)]).repartition(4)
    orders = {
        "UTF8_BINARY": sorted(names),
        "UNICODE": ["_z/CLAUDE.md", "a/CLAUDE.md", "A/CLAUDE.md", "B/CLAUDE.md", decomposed, composed, "e/CLAUDE.md", "z1/CLAUDE.md", "z10/CLAUDE.md", "z2/CLAUDE.md"],
    }
    for collation, want in orders.items():
        for _ in range(2):
            a = audit(gone, weigher="bytes4", path_collation=collation)
            assert [(r["imported_path"], r["importer_path"]) for r in a.claims.collect()] == [("shared.md", want[0])]
            assert [r["label"] for r in a.budget_ranked.orderBy("rank").collect()] == want  # one claims, all weigh the same but it
            assert [r["first_file"] for r in a.finding_groups.collect()] == [want[0]]
            from weighbridge.sinks import sarif_lines

            lines = sarif_lines(a.findings, a.health, collation=collation).where("section = 1").orderBy("p").collect()
            assert [r["line"].split('"uri":"')[1].split('"')[0] for r in lines] == want
            a.release()
    only = files_df(spark, [(n, "@../shared.md\n") for n in (composed, decomposed)] + [("shared.md", "s" * 40)])
    got = audit(only, weigher="bytes4", path_collation="UNICODE").claims.collect()
    assert [r["importer_path"] for r in got] == [decomposed]  # equal by collation: binary order decides


def test_a_path_is_walked_once_and_plain_ones_not_at_all(spark):
    from pyspark.sql import functions as F

    rows = [("a/b.md", "c.md", "a/c.md"), ("b.md", "c/d.md", "c/d.md"), ("a/b.md", "../c.md", "c.md"), ("a/b.md", "../../c.md", None), ("a/b.md", "./x//y/../c.md", "a/x/c.md"),
            ("a/b.md", "/c.md", None), ("b.md", "..a/.b/c..md", "..a/.b/c..md"), ("a//b.md", "c.md", "a/c.md"), ("b.md", "", None), ("b.md", ".", None), ("a/b.md", "..", None), ("a/b.md", "x/", "a/x"), (None, "c.md", None), ("a/b.md", None, None)]
    df = spark.createDataFrame(rows, "importer string, spec string, want string").repartition(2)
    out = df.withColumn("got", resolve_import(F.col("importer"), F.col("spec")))
    assert [(r["importer"], r["spec"]) for r in out.collect() if r["got"] != r["want"]] == []
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
