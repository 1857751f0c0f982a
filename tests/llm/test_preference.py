import duckdb

from tidemark.llm import preference


def render(turns):
    return "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in turns)


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def mask(turns):
        at, out = 0, []
        for role, text in turns:
            head, at = at + len(f"<|{role}|>\n"), at + len(render([(role, text)]))
            if role == "assistant":
                out.append((head, at))
        return out

    return n, render(chosen[:n]), render(chosen[n:]), render(rejected[n:]), mask(chosen[n:]), mask(rejected[n:])


PAIRS = {
    1: ([("user", "hi"), ("assistant", "hello you")], [("user", "hi"), ("assistant", "go")]),
    2: ([("user", "hi"), ("assistant", "a"), ("user", "b"), ("assistant", "c")], [("user", "hi"), ("assistant", "x"), ("user", "b")]),
    3: ([("user", "same")], [("user", "same")]),
    4: ([("user", "é😀"), ("assistant", "")], []),
    5: ([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]),
    6: ([("assistant", "first")], [("user", "first")]),
}


def test_pairs_against_brute_force(spark):
    rows = [(p, side, k, role, text) for p, sides in PAIRS.items() for side, turns in zip(("chosen", "rejected"), sides) for k, (role, text) in enumerate(turns)]
    out = {r.pair_id: r for r in preference.format_pairs(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")).collect()}
    assert out.keys() == PAIRS.keys()
    for p, sides in PAIRS.items():
        n, prompt, chosen, rejected, cm, rm = brute(*sides)
        r = out[p]
        assert (r.n_prompt_turns, r.prompt, r.chosen, r.rejected) == (n, prompt, chosen, rejected)
        assert [tuple(x) for x in r.chosen_mask] == cm and [tuple(x) for x in r.rejected_mask] == rm
        assert r.differ == bool(chosen or rejected)


def test_nulls_empty_and_other_columns(spark):
    schema = "pair_id long, side string, turn long, role string, text string, c string, r string, n int, pair int"
    odd = spark.createDataFrame([(1, "chosen", None, None, None, "c", "r", 1, 2), (1, "rejected", 1, "user", None, "c", "r", 1, 2), (None, "chosen", 0, "user", "x", "c", "r", 1, 2), (2, None, 0, "user", "x", "c", "r", 1, 2)], schema)
    out = {r.pair_id: r for r in preference.format_pairs(odd).collect()}
    assert out[1].chosen == "<||>\n<|end|>\n" and out[1].rejected == "<|user|>\n<|end|>\n"
    assert out[None].rejected == "" and out[None].n_prompt_turns == 0 and out[2].chosen == "" == out[2].prompt
    assert preference.format_pairs(odd.limit(0)).count() == 0
    assert preference.with_cut_replies(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query_against_sql(spark, data):
    got = preference.op6_preference(spark, f"{data}/sf0.001")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/sf0.001/conversations.parquet'")
    want = con.execute(preference.OP6_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
    assert got.where("differ").count() > 0
