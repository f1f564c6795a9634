from pyspark.sql import functions as F

from tests.conftest import files_df
from weighbridge import audit


def _costs(spark, rows):
    a = audit(files_df(spark, rows), weigher="bytes4")
    return {r["server"]: (r["tokens"], r["note"]) for r in a.mcp_costs.collect()}, a


def test_missing_malformed_and_wrong_shape(spark):
    assert _costs(spark, [("CLAUDE.md", "x")])[0] == {}
    assert _costs(spark, [(".mcp.json", "{bad")])[0] == {}
    assert _costs(spark, [(".mcp.json", '{"servers":{}}')])[0] == {}
    assert _costs(spark, [(".mcp.json", '{"mcpServers":[1,2]}')])[0] == {}
    assert _costs(spark, [(".mcp.json", '{"mcpServers":"x"}')])[0] == {}


def test_inline_manifest_and_offline(spark):
    cfg = (
        '{"mcpServers":{'
        '"inline":{"tools":[{"name":"a","x":1}]},'
        '"empty_inline":{"tools":[],"toolsFile":"arr.json"},'
        '"arr_empty":{"manifest":"empty.json"},'
        '"obj_empty":{"toolsFile":"objempty.json"},'
        '"obj":{"toolsFile":"sub/obj.json"},'
        '"missing":{"toolsFile":"nope.json"},'
        '"null_file":{"toolsFile":null,"manifest":"arr.json"},'
        '"num_file":{"toolsFile":5,"manifest":"arr.json"},'
        '"runtime":{"command":"run"},'
        '"a.b":{"tools":[{"n":2}]}'
        "}}"
    )
    rows = [
        (".mcp.json", cfg),
        ("arr.json", '[{"name":"t1"},{"name":"t2"}]'),
        ("empty.json", "[]"),
        ("objempty.json", '{"tools":[]}'),
        ("sub/obj.json", '{ "tools" : [ {"name": "deep"} ] }'),
    ]
    got, a = _costs(spark, rows)
    note = "schemas not available offline"
    tools = {r["server"]: r["tools_json"] for r in a.mcp_servers.collect()}
    assert tools["inline"] == '[{"name":"a","x":1}]'
    assert tools["empty_inline"] == '[{"name":"t1"},{"name":"t2"}]'
    assert tools["obj"] == '[{"name":"deep"}]'  # compact, key order kept
    assert tools["a.b"] == '[{"n":2}]'
    assert got["arr_empty"] == (1, None)  # "[]" costs its own tokens, no note
    assert got["obj_empty"] == (0, note)
    assert got["missing"] == (0, note)
    assert got["runtime"] == (0, note)
    assert got["null_file"] == got["empty_inline"]  # null toolsFile falls through to manifest
    assert got["num_file"] == (0, note)  # non-string reference: no tools
    order = [r["server"] for r in a.mcp_servers.orderBy("ord").collect()]
    assert order[0] == "inline" and order[-1] == "a.b"
    e = {r["label"]: r for r in a.budget_entries.collect()}
    assert e["mcp:inline (schemas)"]["load"] == "always" and e["mcp:runtime (schemas)"]["note"] == note


def test_odd_server_names_repeated_keys_and_order(spark):
    cfg = (
        '{"x":1,"x":2,"mcpServers":{"b":{"tools":[1]},"o\'k":{"tools":[{"n":1}]},"*":{"tools":[2]},"10":{"tools":[3]},'
        '"9":{"tools":[4]},"b":{"tools":[5]},"a b":{"toolsFile":"data.txt"},"":{"command":"y"},"09":null}}'
    )
    rows = [(".mcp.json", cfg), ("data.txt", '[{"from":"text"}]')]
    a = _costs(spark, rows)[1]
    got = [(r["server"], r["tools_json"]) for r in a.mcp_servers.orderBy("ord").collect()]
    assert got == [
        ("9", "[4]"), ("10", "[3]"), ("b", "[5]"), ("o'k", '[{"n":1}]'), ("*", "[2]"), ("a b", '[{"from":"text"}]'), ("", None), ("09", None),
    ]


def test_entries_of_any_shape(spark):
    cfg = (
        '{"mcpServers":{"n":5,"l":[{"tools":[1]}],"z":null,"s":{"tools":"[1]","manifest":"m.json"},"d":{"tools":[],"toolsFile":"no.json","manifest":"m.json"},'
        '"t":{"tools":{"a":1},"toolsFile":["m.json"]},"e":{"tools":[null]},"u":{"command":"x","tools":[{"b":1,"a":[2, "q"]}],"toolsFile":"m.json"}}}'
    )
    rows = [(".mcp.json", cfg), ("m.json", ' {"other":1,"tools":[{"k":"v"}]}')]
    got = {r["server"]: r["tools_json"] for r in _costs(spark, rows)[1].mcp_servers.collect()}
    assert got == {"n": None, "l": None, "z": None, "s": '[{"k":"v"}]', "d": None, "t": None, "e": "[null]", "u": '[{"b":1,"a":[2,"q"]}]'}
    for bad in ('[{"mcpServers":{"a":{"tools":[1]}}}]', '{"mcpServers":{"a":{"tools":[1]}},', "null", "", "{}", '{"mcpServers":null}', '{"mcpServers":{}}'):
        assert _costs(spark, [(".mcp.json", bad)])[0] == {}


def test_config_of_many_servers_and_repeated_names(spark):
    import json
    import random
    import time

    rnd = random.Random(8)
    names = [str(rnd.randrange(3000)) if i % 3 else f"s{rnd.randrange(6000)}" for i in range(20_000)]
    cfg = '{"mcpServers":{' + ",".join(f'{json.dumps(n)}:{{"tools":[{i}]}}' for i, n in enumerate(names)) + "}}"
    t0 = time.time()
    got = [(r["server"], r["tools_json"]) for r in _costs(spark, [(".mcp.json", cfg)])[1].mcp_servers.orderBy("ord").collect()]
    assert time.time() - t0 < 30  # quadratic work takes minutes
    first, last = {}, {}
    for i, n in enumerate(names):
        first.setdefault(n, i)
        last[n] = i
    order = sorted(first, key=lambda n: (int(n), 0) if n.isdigit() else (10**9, first[n]))
    assert got == [(n, f"[{last[n]}]") for n in order]


def test_configs_of_one_partition_are_parsed_by_many_tasks(spark):
    from weighbridge.operators.mcp import server_table

    rows = [(f"r{i}", ".mcp.json", f'{{"mcpServers":{{"s{i}":{{"tools":[{{"n":{i}}}]}}}}}}') for i in range(400)]
    files = spark.createDataFrame(rows, "repo_id string, rel_path string, content string").coalesce(1)
    servers = server_table(files)
    assert {(r["repo_id"], r["inline_tools"]) for r in servers.collect()} == {(f"r{i}", f'[{{"n":{i}}}]') for i in range(400)}
    assert len(servers.inputFiles()) > 1


def test_configs_that_cannot_name_servers_are_not_dealt_out(spark, monkeypatch):
    from weighbridge.operators import mcp

    texts = ['{"mcpServers":{"a":{"tools":[1]}}}', '{"mcp\\u0053ervers":{"b":{"command":"x"}}}', "{bad", '{"servers":{}}', "", None, '{"x":"mcpServers"}']
    dealt = []
    monkeypatch.setattr(mcp, "dealt_out", lambda df: dealt.append(df) or df)
    servers = mcp.server_table(files_df(spark, [(".mcp.json", t) for t in texts] + [("docs/n.md", texts[0])]))
    assert sorted((r["server"], r["inline_tools"]) for r in servers.collect()) == [("a", "[1]"), ("b", None)]
    assert sorted(r["content"] for r in dealt[0].collect()) == sorted([texts[0], texts[1], texts[6]])


def test_manifests_are_matched_without_shuffling_other_text(spark):
    import re

    from weighbridge.operators.mcp import mcp_servers

    cfg = '{"mcpServers":{"a":{"toolsFile":"x/t.json"},"b":{"manifest":"./x//t.json"},"c":{"manifest":"prose.md"},"d":{"tools":[{"n":1}]},"e":{"command":"tools"},"f":{"manif\\u0065st":"l.json"},"g":{"command":"x"}}}'
    text = [(".mcp.json", cfg), ("x/t.json", '\ufeff \n{"tools":[{"m":2}]}'), ("l.json", "\r\n\t[1, 2]"), ("prose.md", "no JSON"), ("prose.md", "again"), ("x/t.json", None)]
    files = spark.createDataFrame([("r", p, c) for p, c in text] + [(None, ".mcp.json", cfg)], "repo_id string, rel_path string, content string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        servers = mcp_servers(files)
        plan = servers._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        got = sorted((r["repo_id"] or "", r["server"], r["tools_json"] or "") for r in servers.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffled = re.findall(r"\) Exchange\s*\nInput[^\n]*", plan)
    assert shuffled and not [x for x in shuffled if "content#" in x]
    bom = '[{"m":2}]' if spark.sql("SELECT try_parse_json(decode(X'EFBBBF', 'UTF-8') || '[]') IS NOT NULL").first()[0] else ""
    # a path that two files have gives a row each, as ever
    of = {"a": ["", bom], "b": ["", bom], "c": ["", ""], "d": ['[{"n":1}]'], "e": [""], "f": ["[1,2]"], "g": [""]}
    assert got == sorted([("r", s, t) for s, ts in of.items() for t in ts] + [("", s, '[{"n":1}]' if s == "d" else "") for s in of])


def test_first_character_of_a_manifest(spark):
    from weighbridge.operators.mcp import JSON_OPENS, MAY_OPEN

    texts = ["[]", "{}", " [", "\ufeff[", "\u0000\u001f\n\t{", "x[", "", " ", "\u00a0[", "\U0001f600[", "\n\nx", "@[", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    one, both = F.substring("t", 1, 1).rlike(MAY_OPEN) & F.col("t").rlike(JSON_OPENS), F.col("t").rlike(JSON_OPENS)
    got = df.select(one.alias("one"), both.alias("both")).collect()
    assert [r["one"] for r in got] == [r["both"] for r in got]
    assert [bool(r["one"]) for r in got] == [True, True, True, True, True] + [False] * 8
