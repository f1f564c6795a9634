import posixpath
import re

from pyspark.sql import functions as F

from tests.conftest import files_df
from weighbridge import audit

IMPORT = re.compile(r"^[ \t]*@([./\w-]+\.(?:markdown|mdx|mdc|md|txt|rst))(?![A-Za-z0-9_])", re.I | re.M | re.A)


def _resolve(src, spec):
    if spec.startswith("/"):
        return None
    d = posixpath.dirname(src)
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


def model(files, context):
    """The stated semantics as set fixpoints: what each start file folds in and misses, then
    each folded file goes to the smallest start file that reaches it."""
    edges = {p: [(spec, _resolve(p, spec)) for spec in IMPORT.findall(text)] for p, text in files.items()}
    inner = {p: {t for _, t in es if t in files and t not in context} for p, es in edges.items()}
    folded = {}
    for start in context:
        reached, size = inner[start] - {start}, -1
        while len(reached) != size:
            size = len(reached)
            reached = reached | {t for p in reached for t in inner[p]} - {start}
        folded[start] = reached
    payer = {p: min(s for s in context if p in folded[s]) for p in set().union(*folded.values())}
    return {
        s: (
            sorted(p for p in folded[s] if payer[p] == s),
            sorted({spec for p in folded[s] | {s} for spec, t in edges[p] if t not in files}),
        )
        for s in context
    }


def spark_result(spark, files):
    a = audit(files_df(spark, list(files.items())), weigher="bytes4")
    context = {r["rel_path"] for r in a.context.collect()}
    claims = {}
    for r in a.claims.collect():
        claims.setdefault(r["importer_path"], []).append(r["imported_path"])
    unres = {}
    for r in a.unresolved.collect():
        unres.setdefault(r["root_path"], []).append(r["spec"])
    got = {c: (sorted(claims.get(c, [])), sorted(unres.get(c, []))) for c in context}
    return context, got


GRAPH = {
    "CLAUDE.md": "@AGENTS.md\n@docs/a.md\n@CLAUDE.md\n  @docs/missing.md\nsee @docs/mid.md\n@db.Text\n",
    "AGENTS.md": "@docs/a.md\n@docs/b.md\n@/abs.md\n@../above.md\n",
    "docs/a.md": "@b.md\n@c.md\n",
    "docs/b.md": "@a.md\n@gone.md\n",  # two-cycle with a.md; broken import found at depth 2
    "docs/c.md": "@d/e.md\n",
    "docs/d/e.md": "@f.md\n",
    "docs/d/f.md": "@../g.md\n",
    "docs/g.md": "```\n@h.md\n```\n",  # code fences are not excluded
    "docs/h.md": "end",
    "docs/mid.md": "never imported",
    "pkg/CLAUDE.md": "@../docs/b.md\n@../node_modules/x/AGENTS.md\n@X.MD\n@y.mdx\n@z.md.bak\n@w.mdé\n",
    "node_modules/x/AGENTS.md": "hidden context file: folded",
    "pkg/X.MD": "upper",
    "pkg/y.mdx": "mdx",
    "pkg/z.md": "prefix of z.md.bak",
    "pkg/w.md": "prefix of w.mdé",
}


def test_closure_claims_and_unresolved_match_model(spark):
    context, got = spark_result(spark, GRAPH)
    assert context == {"CLAUDE.md", "AGENTS.md", "pkg/CLAUDE.md"}
    assert got == model(GRAPH, context)
    # the first importer in path order (AGENTS.md < CLAUDE.md) claims the shared tree
    assert got["AGENTS.md"][0] == ["docs/a.md", "docs/b.md", "docs/c.md", "docs/d/e.md", "docs/d/f.md", "docs/g.md", "docs/h.md"]
    assert got["CLAUDE.md"][0] == []
    assert "gone.md" in got["CLAUDE.md"][1] and "gone.md" in got["AGENTS.md"][1]


def test_edges_syntax(spark):
    a = audit(files_df(spark, list(GRAPH.items())), weigher="bytes4")
    specs = {(r["src_path"], r["spec"]) for r in a.edges.collect()}
    assert ("CLAUDE.md", "docs/missing.md") in specs  # indented
    assert ("CLAUDE.md", "docs/mid.md") not in specs  # mid-line mention
    assert not any(s == "db.Text" for _, s in specs)
    assert {("pkg/CLAUDE.md", s) for s in ["X.MD", "y.mdx", "z.md", "w.md"]} <= specs
    assert ("docs/g.md", "h.md") in specs
    bad = {r["spec"] for r in a.edges.where(F.col("dst_path").isNull()).collect()}
    assert bad == {"/abs.md", "../above.md"}


def test_budget_folds_imported_tokens(spark):
    files = {"CLAUDE.md": "@a.md\n", "a.md": "x" * 400, "AGENTS.md": "@a.md\n"}
    a = audit(files_df(spark, list(files.items())), weigher="bytes4")
    e = {r["label"]: r for r in a.budget_entries.collect()}
    # AGENTS.md sorts first, so it claims a.md; CLAUDE.md pays only its own tokens
    assert e["AGENTS.md"]["imported_tokens"] == 100 and e["AGENTS.md"]["n_imports"] == 1
    assert e["AGENTS.md"]["tokens"] == 2 + 100
    assert e["CLAUDE.md"]["imported_tokens"] is None and e["CLAUDE.md"]["tokens"] == 2


def test_claim_order_collation(spark):
    files = {"_z/CLAUDE.md": "@../shared.md\n", "A/CLAUDE.md": "@../shared.md\n", "shared.md": "x" * 40}
    df = files_df(spark, list(files.items()))
    binary = {r["imported_path"]: r["importer_path"] for r in audit(df, weigher="bytes4").claims.collect()}
    icu = {r["imported_path"]: r["importer_path"] for r in audit(df, weigher="bytes4", path_collation="UNICODE").claims.collect()}
    assert binary == {"shared.md": "A/CLAUDE.md"}  # 'A' < '_' in bytes
    assert icu == {"shared.md": "_z/CLAUDE.md"}  # punctuation sorts first in ICU root order
    e = {r["label"]: r["imported_tokens"] for r in audit(df, weigher="bytes4", path_collation="UNICODE").budget_entries.collect()}
    assert e == {"_z/CLAUDE.md": 10, "A/CLAUDE.md": None}


def _first_places(files, context):
    """Every simple path from each start file, by brute force: the smallest position list of each broken spec."""
    edges = {p: [(spec, _resolve(p, spec)) for spec in IMPORT.findall(text)] for p, text in files.items()}
    best, todo = {}, [((), (c,)) for c in context]
    while todo:
        place, trail = todo.pop()
        for at, (spec, target) in enumerate(edges[trail[-1]]):
            here = (*place, at)
            if target not in files:
                best[trail[0], spec] = min(best.get((trail[0], spec), here), here)
            elif target not in context and target not in trail:
                todo.append((here, (*trail, target)))
    return best


def test_broken_specs_in_tree_order(spark):
    files = [("CLAUDE.md", "@a.md\n@missing2.md\n"), ("a.md", "@missing1.md\n")]
    a = audit(files_df(spark, files), weigher="bytes4")
    rows = a.findings.where("rule_ord = 4").orderBy("item_ord").collect()
    assert [(r["item_ord"], r["message"].split('"')[1]) for r in rows] == [([0, 0], "@missing1.md"), ([1], "@missing2.md")]


def test_broken_spec_places_match_all_simple_paths(spark):
    import random

    rng, repos = random.Random(5), {}
    for k in range(8):
        names = ["CLAUDE.md", "AGENTS.md", *[f"n{i}.md" for i in range(6)]]
        targets = [*names, "gone1.md", "gone2.md", "gone3.md"]
        repos[f"r{k}"] = {n: "".join(f"@{rng.choice(targets)}\n" for _ in range(rng.randint(0, 4))) for n in names}
    rows = [(r, p, t) for r, files in repos.items() for p, t in files.items()]
    df = spark.createDataFrame(rows, "repo_id string, rel_path string, content string")
    got = {(r["repo_id"], r["root_path"], r["spec"]): tuple(r["place"]) for r in audit(df, weigher="bytes4").unresolved.collect()}
    want = {(k, *key): v for k, files in repos.items() for key, v in _first_places(files, {"CLAUDE.md", "AGENTS.md"}).items()}
    assert got == want and len(want) > 15


def test_one_path_order_for_ties_and_findings(spark):
    gone = "@gone.md\n"
    df = files_df(spark, [("_z/CLAUDE.md", gone), ("A/CLAUDE.md", gone)])
    for collation, first in (("UTF8_BINARY", "A/CLAUDE.md"), ("UNICODE", "_z/CLAUDE.md")):
        a = audit(df, weigher="bytes4", path_collation=collation)
        assert a.budget_ranked.orderBy("rank").first()["label"] == first
        assert [r["first_file"] for r in a.finding_groups.collect()] == [first]
        assert [r["first_file"] for r in a.distinct_suggestions.collect()] == [first]
        assert a.problem_summary.count() == 1 and a.top_suggestions.count() == 1


def _model_walk(files, context):
    """Claims and broken specs by the plain walk, with an explicit stack: ``{spec: place}`` per start file."""
    found, claimed = {}, {}
    for start in sorted(context):
        visited, stack, out = {start}, [(start, (), 0)], {}
        while stack:
            node, place, i = stack.pop()
            specs = IMPORT.findall(files[node])
            if i == len(specs):
                continue
            stack.append((node, place, i + 1))
            target = _resolve(node, specs[i])
            if target not in files:
                out.setdefault(specs[i], (*place, i))
            elif target not in visited:
                visited.add(target)
                if target not in context:
                    claimed.setdefault(target, start)
                    stack.append((target, (*place, i), 0))
        found[start] = out
    return found, claimed


def _rounds(monkeypatch):
    from weighbridge.operators import imports

    labels, write = [], imports.materialize
    monkeypatch.setattr(imports, "materialize", lambda df, label="step": labels.append(label) or write(df, label))
    return labels


def _check_walk(spark, repos):
    rows = [(r, p, t) for r, files in repos.items() for p, t in files.items()]
    df = spark.createDataFrame(rows, "repo_id string, rel_path string, content string")
    context = {"CLAUDE.md", "AGENTS.md"}
    a = audit(df, weigher="bytes4")
    got = {(r["repo_id"], r["root_path"], r["spec"]): tuple(r["place"]) for r in a.unresolved.collect()}
    claims = {(r["repo_id"], r["imported_path"]): r["importer_path"] for r in a.claims.collect()}
    want, want_claims = {}, {}
    for k, files in repos.items():
        found, claimed = _model_walk(files, context & set(files))
        want |= {(k, root, spec): place for root, out in found.items() for spec, place in out.items()}
        want_claims |= {(k, f): root for f, root in claimed.items()}
    assert got == want and claims == want_claims
    return want


def test_long_chain_in_few_rounds(spark, monkeypatch):
    n = 2000
    chain = {"CLAUDE.md": "@c0.md\n", "AGENTS.md": f"@c{n // 2}.md\n@c0.md\n"}
    for i in range(n):
        chain[f"c{i}.md"] = f"@c{i + 1}.md\n" if i + 1 < n else "@gone.md\n@c5.md\n"
    chain["c1500.md"] += "@gone2.md\n"
    labels = _rounds(monkeypatch)
    want = _check_walk(spark, {"r": chain})
    assert len(want["r", "CLAUDE.md", "gone.md"]) == n + 1
    jumps = labels.count("forest-jump")
    assert jumps < 30 and labels.count("ways") + labels.count("live") + labels.count("claim") < 15, labels


def test_trees_ladders_cycles_and_dead_ends_contract(spark, monkeypatch):
    import random

    rng = random.Random(3)
    tree = {"CLAUDE.md": "@t1.md\n"} | {f"t{i}.md": f"@t{2 * i}.md\n@t{2 * i + 1}.md\n" for i in range(1, 64)} | {f"t{i}.md": rng.choice(["", f"@gone{i % 5}.md\n"]) for i in range(64, 128)}
    spine = {"CLAUDE.md": "@s0.md\n"} | {f"s{i}.md": f"@l{i}.md\n@s{i + 1}.md\n@m{i}.md\n" for i in range(60)}
    spine |= {f"l{i}.md": "" for i in range(60)} | {f"m{i}.md": f"@gone{i % 7}.md\n" for i in range(60)} | {"s60.md": "@last.md\n"}
    ladder = {"AGENTS.md": "@d0.md\n"}
    for i in range(40):
        ladder |= {f"d{i}.md": f"@a{i}.md\n@b{i}.md\n", f"a{i}.md": f"@d{i + 1}.md\n", f"b{i}.md": f"@d{i + 1}.md\n"}
    ladder["d40.md"] = "@gone.md\n@d3.md\n"
    circle = {"CLAUDE.md": "@a.md\n@x.md\n", "a.md": "@b.md\n", "b.md": "@c.md\n@gone1.md\n", "c.md": "@a.md\n@gone2.md\n", "x.md": "@c.md\n"}
    circle |= {f"o{i}.md": f"@o{(i + 1) % 5}.md\n@gone{i}.md\n" for i in range(5)} | {"p.md": "@q.md\n", "q.md": "@b.md\n"}  # not reached
    labels = _rounds(monkeypatch)
    _check_walk(spark, {"tree": tree, "spine": spine, "ladder": ladder, "circle": circle, "none": {"CLAUDE.md": "x"}, "loop": {"CLAUDE.md": "@e.md\n", "e.md": "@e.md\n@gone.md\n"}})
    assert labels.count("ways") < 10


def test_random_graphs_match_the_walk(spark):
    import random

    rng, repos = random.Random(11), {}
    for k in range(40):
        names = ["CLAUDE.md", "AGENTS.md", *[f"n{i}.md" for i in range(rng.choice([4, 9, 14]))]]
        targets = [*names, "gone1.md", "gone2.md", "gone3.md"]
        repos[f"r{k}"] = {n: "".join(f"@{rng.choice(targets)}\n" for _ in range(rng.choice([0, 1, 1, 2, 3]))) for n in names}
    assert len(_check_walk(spark, repos)) > 40
