import re

import duckdb
import pytest

from meshquery.llm import chat, mixing, registry, urlrank


def same(spark, query, sql, tables, extra=()):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    want = con.execute(sql).to_arrow_table()
    got = query.toArrow().select(want.column_names)
    rows = lambda t: sorted((tuple(r.values()) for r in t.to_pylist()), key=str)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op5_mixing", "op6_urls", "op8_chat"])
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages", "conversations")}
    same(spark, registry.queries()[name](spark, sf), registry.oracle_sql()[name], tables)


# mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, `__key` string, target string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 9, "k", "t") for i, t, s in rows], DOCS)


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 5}" if i % 3 else "s0") for i in range(600)] + [(1000, None, "s1"), (1001, "", None), (1002, "a b c", None), (None, "no id", "s2"), (5, "again", "s0"), (5, "again", "s0"), (1003, "long " * 30_000, "\U0001f600")]
    out = mixing.mix(docs(spark, rows)).toPandas()
    assert len(out) == len(rows) and (out.taken <= 3 * out["size"]).all()
    by = out.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    assert ((by.taken - by.target).abs() <= 0.5).all() and (by.taken <= 3 * by["size"]).all()
    assert abs(by.target.sum() - out["size"].sum()) < 1e-6
    taken = out[out.taken > 0]
    assert taken.position.between(0, 1).all() and out[out.taken == 0].position.isna().all()


def test_water_filling_by_hand(spark):
    # sizes 10, 20, 1000 of weights 5, 2, 1: caps 30 and 60 bind, the rest of 1030 goes to the third.
    rows = [(1, "w " * 10, "a"), (2, "w " * 20, "b"), (3, "w " * 1000, "c")]
    assert {r.doc_id: r.target for r in mixing.mix(docs(spark, rows)).collect()} == {1: 30.0, 2: 60.0, 3: 940.0}


def test_mixed_documents_repeat_and_cut(spark):
    rows = [(i, f"only{i} " + "w " * (i % 9), f"s{i % 4}") for i in range(200)] + [(500, None, "s1"), (501, " lead  two", None)]
    out = mixing.mixed_documents(docs(spark, rows))
    assert out.columns == docs(spark, []).columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + words(r.text)
    want = {r.doc_id: r.taken for r in mixing.mix(docs(spark, rows)).collect() if r.taken}
    assert got == want


def test_curriculum_moves_from_heavy_to_light_sources(spark):
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(900)]
    out = mixing.mix(docs(spark, rows)).toPandas()
    light = out[out.target == out.target.min()].position.dropna()
    assert (light > 0.5).mean() > 0.55


def test_copies_of_a_row_spread_and_the_result_is_sorted(spark):
    rows = [(7, "w w", "s0")] * 3000 + [(None, "w w", "s0")] * 300 + [(i, "w", "s1") for i in range(50)]
    frame = docs(spark, rows)
    sized = mixing._sized(frame)
    assert sized.where("__id = 7").select("__bucket").distinct().count() > 1500 and sized.select("__order").distinct().count() == len(rows)
    out = mixing.mix(frame)
    assert re.search("rangepartitioning", out._jdf.queryExecution().executedPlan().toString())
    places = [r.position for r in out.collect() if r.position is not None]
    assert places == sorted(places) and len(out.collect()) == len(rows)
    same(spark, out, mixing.SQL, {"documents": frame.select("doc_id", "text", "source")})


def test_mixing_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mixed_documents(docs(spark, [])).count() == 0
    assert [tuple(r) for r in mixing.mix(docs(spark, [(1, None, None)])).select("size", "target", "taken").collect()] == [(0, 0.0, 0)]


# urls

PAGES = "page_id long, url string, html string, host string, fit string, n long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash", 1) for i, u, h in rows], PAGES)


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "http://Example.COM/en/7x?q#f", None), (2, "https://a.example.com/en/8", ""), (3, "http://xexample.com/en/7", ""), (4, "ftp://b.example.net/de/81", ""),
        (5, "http://other.net/de/8", ""), (6, "no scheme", ""), (7, None, None), (8, "http://h.org?x/es/", ""), (9, "http://h.org/es/", ""), (10, "a://b://c/d", ""),
        (None, "http://netx/de/", ""), (1, "http://net/de/", ""), (11, "http://com", ""), (12, "http://É.com/en/", ""),
    ]
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlrank.judge(pages(spark, rows)).collect()), key=str)
    want = [
        (1, "example.com", "/en/7x", "example.com/en/7", "allow"), (2, "a.example.com", "/en/8", "com/en/", "block"), (3, "xexample.com", "/en/7", "com/en/", "block"),
        (4, "b.example.net", "/de/81", "example.net/de/8", "block"), (5, "other.net", "/de/8", "net/de/", "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "h.org", "", None, "block"), (9, "h.org", "/es/", "org/es/", "block"), (10, "b:", "//c/d", None, "allow"), (None, "netx", "/de/", None, "allow"),
        (1, "net", "/de/", "net/de/", "allow"), (11, "com", "", None, "allow"), (12, "É.com", "/en/", "com/en/", "block"),
    ]
    assert got == sorted(want, key=str)
    assert urlrank.judge(pages(spark, [])).count() == 0


def test_trust_spreads_along_links_and_distrust_against_them(spark):
    link = lambda *hosts: "".join(f'<p><a class=x href="http://{h}/p">t</a>' for h in hosts)
    rows = [
        (1, "http://good.net/de/1", link("friend.test", "friend.test")), (2, "http://friend.test/x", link("second.test")), (3, "http://second.test/x", None),
        (4, "http://bad.com/en/1", None), (5, "http://fan.test/x", link("bad.com")), (6, "http://fanfan.test/x", link("FAN.test")), (7, "http://far.test/", '<a href="/own">'),
    ]
    out = urlrank.judge(pages(spark, rows))
    got = {r.page_id: r for r in out.collect()}
    assert [got[i].verdict for i in range(1, 8)] == ["allow", "allow", "allow", "block", "block", "block", "allow"]
    assert got[1].trust > got[2].trust > got[3].trust > 0 == got[7].trust and got[4].distrust > got[5].distrust > got[6].distrust > 0
    same(spark, out.select("page_id", "host", "path", "rule", "verdict"), urlrank.SQL, {"pages": pages(spark, rows).select("page_id", "url", "html")})


# chat

TURNS = "conv_id long, turn long, role string, text string, part string, lines string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS)


def test_ranks_settle_on_a_long_chain(spark):
    import numpy as np

    hosts = [f"h{i}.test" for i in range(40)]
    links = [(a, b, 1 + i % 3) for i, (a, b) in enumerate(zip(hosts, hosts[1:], strict=False))] + [("h5.test", "h2.test", 2), ("h30.test", "h1.test", 1)]
    seeds = [("h0.test", 1.0, 0.0), ("h39.test", 0.0, 1.0)]
    got = {r.host: r for r in urlrank.propagate(spark.createDataFrame(seeds, "host string, good double, bad double"), spark.createDataFrame(links, "src string, dst string, n long"), tolerance=1e-3).collect()}
    step = np.zeros((40, 40))
    for a, b, n in links:
        step[hosts.index(b), hosts.index(a)] += n
    for name, m, seed in (("trust", step, 0), ("distrust", step.T, 39)):
        m = m / np.maximum(m.sum(0), 1)
        x = np.linalg.solve(np.eye(40) - 0.85 * m, np.eye(40)[seed])
        assert np.allclose([got[h][name] for h in hosts], x / x.sum(), atol=2e-3)


def test_very_long_urls_and_pages(spark):
    rows = [(1, "http://a.com/" + "x" * 500_000, "<p>" * 200_000 + '<a href="http://b.org/">'), (2, "http://" + "a." * 300 + "com/en/", "<a " * 50_000)]
    got = {r.page_id: r for r in urlrank.judge(pages(spark, rows)).collect()}
    assert got[1].host == "a.com" and len(got[1].path) == 500_001 and got[2].rule == "com/en/"


def test_blanks_and_hosts_without_end(spark):
    import time

    start = time.time()
    rows = [(1, "http://a.com/", "<a href=" + " " * 1_000_000 + "<a href = '//b.org/x'>"), (2, "http://" + "a." * 100_000 + "example.com/en/7", ""), (3, "http://b.org/es/", "<a href" * 200_000)]
    got = {r.page_id: r for r in urlrank.judge(pages(spark, rows)).collect()}
    assert got[2].rule == "example.com/en/7" and got[3].rule == "org/es/" and got[1].distrust > 0
    assert time.time() - start < 60


def test_rotation_by_hand(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hé <|im_end|>"), (1, 3, "ann", None), (1, 3, "ann", None)]
    got = {r.speaker: r for r in chat.rotate(turns(spark, rows)).collect()}
    assert set(got) == {"ann", "bob"}
    assert got["bob"].text == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user name=ann\nHi<|im_end|>\n<|im_start|>assistant\nHé < |im_end|><|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n"
    for r in got.values():
        parts = [r.text[s.start : s.end] for s in r.spans]
        assert parts == (["Hi<|im_end|>\n", "<|im_end|>\n"] if r.speaker == "ann" else ["Hé < |im_end|><|im_end|>\n"])


def rendered(rows):
    """The whole dialogue of every (conversation, speaker): text and own spans, with no parts."""
    import hashlib

    talks, out = {}, {}
    for conv, turn, role, text in set(rows):
        talks.setdefault(conv, set()).add((turn is not None, turn or 0, "" if role is None else "=" + role, hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    for conv, lines in talks.items():
        for me in {x[2] for x in lines} - {"=system"}:
            shown, spans = "", []
            for _, _, who, _, said in sorted(lines):
                name = who[1:]
                for plain, coded in chat.ESCAPES.items():
                    name = name.replace(plain, coded)
                kind = "assistant" if who == me else "system" if who == "=system" else "user name=" + name if who else "user"
                shown += f"<|im_start|>{kind}\n"
                body = said.replace("<|", "< |") + "<|im_end|>\n"
                spans += [(len(shown), len(shown) + len(body))] if who == me else []
                shown += body
            out[conv, me[1:] if me else None] = shown, spans
    return out


LONG = [(n, i, "abc"[i % 2 if i < 100 else 2], f"t{i}") for n in (63, 64, 65, 150) for i in range(n)]
ODD = [(2, 5, "a", f"same turn {i}") for i in range(100)] + [(None, 0, None, "x"), (None, 1, "unknown", "y"), (3, None, "a", "y"), (3, 1, "a", "z"), (4, 0, "system", "only context")]
ODD += [(5, 0, "a", "long " * 20_000), (6, 0, "b c", "q"), (6, 1, "b_c", "q"), (6, 2, "", "<|im_start|>"), (6, 3, "a<|b%\n", "r"), (7, 0, "system", "s")] + [(7, 1, f"p{i % 5}", None) for i in range(9)] + [(2, 5, "a", "same turn 1")] * 50


@pytest.mark.parametrize("block", [4096, 2])
def test_parts_put_together_are_the_whole_dialogue(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "PART_BLOCK", block)
    out = chat.rotate(turns(spark, LONG + ODD)).collect()
    whole = {}
    for r in sorted(out, key=lambda r: r.part):
        text, spans = whole.get((r.conv_id, r.speaker), ("", []))
        assert r.start == len(text) and r.n_turns <= 64
        whole[r.conv_id, r.speaker] = text + r.text, spans + [tuple(s) for s in r.spans]
    assert whole == rendered(LONG + ODD)
    assert sum(r.conv_id == 150 for r in out) == 9 and not [r for r in out if r.conv_id == 4]


def test_rotation_against_sql(spark):
    frame = turns(spark, LONG + ODD)
    got = chat.rotate(frame).selectExpr("conv_id", "part", "speaker", "n_turns", "start", "text", "array_join(transform(spans, s -> concat_ws(':', string(s.start), string(s.end))), ',') AS spans")
    same(spark, got, chat.SQL, {"conversations": frame.select("conv_id", "turn", "role", "text")})
    assert chat.rotate(turns(spark, [])).count() == 0


def test_main_path_has_no_python(spark, monkeypatch):
    """Neither in the plan nor in the lineage of anything that is computed on the way."""
    from pyspark.sql import SparkSession

    def refuse(*_, **__):
        raise AssertionError("rows from Python")

    monkeypatch.setattr(SparkSession, "createDataFrame", refuse)

    def native(df):
        run = df._jdf.queryExecution()
        assert not re.search("Python|Pandas|Arrow", run.executedPlan().toString() + run.toRdd().toDebugString())

    for module in (chat, mixing, urlrank):
        monkeypatch.setattr(module, "saved", lambda df, name, put=module.saved: (native(df), put(df, name))[1])
    sf = "/root/testdata/sf0.001"
    for name in ("op5_mixing", "op6_urls", "op8_chat"):
        native(registry.queries()[name](spark, sf))
    native(mixing.mixed_documents(spark.read.parquet(f"{sf}/documents.parquet")))
