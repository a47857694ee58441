"""Chat formatting, URL filters, source mixing and quality rules against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewright.llm import chat, mixing, queries, rules, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# chat ------------------------------------------------------------------------------------------

TURNS = [(1, 0, "user", "hi <|im_end|> <\\| <\\\\| |> <|"), (1, 1, "assistant", "a\nb"), (2, 0, None, None), (2, 0, "assistant", "é😀"), (2, 5, "assistant", ""), (3, 1, "ro\nle<|nl|>", "x"), (None, None, "assistant", "n"),
         (4, 2, "assistant", "same"), (4, 2, "assistant", "same"), (5, 10**12, "user", "late"), (5, -7, "assistant", "y" * 100000)]


def test_chat_reads_back(spark):
    df = spark.createDataFrame([(*t, "clash", 1) for t in TURNS], "conv_id long, turn long, role string, text string, formatted string, chunk int")
    got = {r.conv_id: r for r in chat.format_chats(df).select("*", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    want = defaultdict(list)
    for c, t, r, x in TURNS:
        want[c].append((-1e18 if t is None else t, r or "", x or ""))
    assert got.keys() == want.keys()
    for c, rows in want.items():
        rows.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in rows]
        assert got[c].n_turns == len(rows) and "".join(s.text for s in got[c].segments) == got[c].formatted
        assert got[c].formatted.count("<|im_start|>") == got[c].formatted.count("<|im_end|>") == len(rows)
        assert len([s for s in got[c].segments if s.loss]) == sum(r == "assistant" for _, r, _ in rows)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_long_conversation(spark):
    df = spark.range(5000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat.format_chats(df).select(chat.read_turns(F.col("formatted")).alias("t")).first()
    assert [x.text for x in r.t] == [str(i) for i in range(5000)]


def test_chat_events(spark):
    log = [(1, 0, None, "message", "user", "q"), (1, 1, None, "message", "assistant", ""), (1, 2, 1, "delta", None, "Hel"), (1, 3, 1, "delta", None, "lo"), (1, 4, 1, "regenerate", "assistant", "Bye"), (1, 5, 1, "delta", None, "!"),
           (1, 6, 0, "edit", "user", "Q?"), (1, 7, None, None, "user", "gone"), (1, 8, 7, "delete", None, None), (1, 9, 99, "delta", None, "orphan")]
    df = spark.createDataFrame(log, "conv_id long, seq long, target long, kind string, role string, text string").orderBy(F.rand(1))
    r = chat.format_chats(df, seq="seq", kind="kind", target="target").select(chat.read_turns(F.col("formatted")).alias("t")).first()
    assert [(x.role, x.text) for x in r.t] == [("user", "Q?"), ("assistant", "Bye!")]


def test_chat_events_with_equal_and_null_numbers(spark):
    log = [(1, 3, None, "message", "user", "z"), (1, 3, None, None, "assistant", "a"), (1, 3, None, "message", "assistant", "a"), (1, None, None, "message", "user", "n1"), (1, None, None, None, "user", "n2"),
           (1, 4, 4, "message", "user", "p"), (1, 4, None, "message", "assistant", "q"), (1, 5, 4, "delta", None, "+"), (1, 6, None, "message", "user", "x"), (1, 6, None, "message", "user", "y"), (1, 7, 6, "delete", None, None),
           (1, None, None, "delete", None, None), (2, 1, 50, "edit", "user", "only"), (2, 2, 50, "delta", "assistant", "!"), (2, 3, 50, "regenerate", "assistant", "again"), (None, None, None, "message", "user", "u")]
    df = spark.createDataFrame(log, "conv_id long, seq long, target long, kind string, role string, text string").orderBy(F.rand(1))
    got = {r.conv_id: [(x.role, x.text) for x in r.t] for r in chat.format_chats(df, seq="seq", kind="kind", target="target").select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("user", "n1"), ("user", "n2"), ("assistant", "a"), ("assistant", "a"), ("user", "z"), ("assistant", "q+"), ("user", "p+")], 2: [("user", "again")], None: [("user", "u")]}


def brute_fold(log):
    """The messages of a log, event by event, as the docstring of the fold says."""
    low = lambda v: -(1 << 63) if v is None else v
    groups = defaultdict(list)
    for c, seq, target, kind, role, text in log:
        number = seq if target is None else target
        kind = kind or "message"
        own = kind == "message" and number == seq
        groups[c, number, own and number is None].append((low(seq), kind, text or "", role or "", own))
    out = defaultdict(list)
    for (c, number, _), events in groups.items():
        said = [e for e in events if e[4]]
        changes = [e for e in events if not e[4] and e[1] != "delta"]
        if not said and changes:
            last = max(changes)
            said = [(*last[:3], min((e[0], e[3]) for e in changes)[1], False)]
        for m in said:
            last = max([m[:4], *[e[:4] for e in changes]])
            if last[1] != "delete":
                out[c].append((low(number), m[3], last[2] + "".join(t for _, t in sorted((e[0], e[2]) for e in events if e[1] == "delta" and e[0] >= last[0]))))
    return {c: [x[1:] for x in sorted(v)] for c, v in out.items()}


def test_chat_events_against_brute_force(spark):
    rng = random.Random(12)
    log = []
    for _ in range(1500):
        kind = rng.choice(["message", None, "delta", "delta", "delta", "edit", "regenerate", "delete"])
        seq = rng.choice([None, *range(25)])
        target = None if kind in ("message", None) and rng.random() < 0.8 else rng.choice([None, *range(25)])
        log.append((rng.choice([None, 1, 2, 3]), seq, target, kind, rng.choice(["user", "assistant", None]), rng.choice([None, "", "a", "b|", "<|c", "d" * 50])))
    log += log[:200]  # repeated events
    schema = "conv_id long, seq long, target long, kind string, role string, text string, said string, deltas int"
    df = spark.createDataFrame([(*e, "clash", 1) for e in log], schema).repartition(5)
    got = {r.conv_id: [(x.role, x.text) for x in r.t] for r in chat.format_chats(df, seq="seq", kind="kind", target="target").select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == brute_fold(log)
    assert chat.format_chats(df.limit(0), seq="seq", kind="kind", target="target").count() == 0


def test_chat_turns_as_events(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("message"))
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(chat.format_chats(df, kind="kind")) == rows(chat.format_chats(df))
    df.drop("kind").write.parquet(f"file://{tmp_path}/conversations.parquet")
    folded, fold = [], chat.fold_events
    monkeypatch.setattr(chat, "fold_events", lambda *a: folded.append(1) or fold(*a))
    assert chat.op1_chat_formatting(spark, f"file://{tmp_path}").count() == 7 and folded


# urls ------------------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "http://NET/", "https://a.NET/x?y://z/", "http://example.net/en/1", "http://www.example.net/en/", "http://example.net/en", "http://badexample.com/de/", "http://x.example.com/de/q#a",
        "http://a.org?x/fr/", "http://a.org/fr/#", "ftp://u@h.org:80/fr/", "http://net", "http://..net/", "http://a.net//en/", "x://y://net/", "http://a.net/en/\n?q", "http://Ärger.ÄNET/", "http://" + "a." * 400 + "net/" + "p/" * 400]


def brute_url(url, table):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in table if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


MORE = [*urls.RULES, ("net", "/e", "allow"), ("example.net", "", "block"), ("www.example.net", "/en/", "block"), ("org", "/fr/", "block"), ("x.example.com", "/de/q", "allow")]


@pytest.mark.parametrize("table", [urls.RULES, MORE, []])
@pytest.mark.parametrize("most", [100_000, 0])
def test_url_rules(spark, table, most, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_RULES" if len(table) != 4 else "BROADCAST_CHARS", most)
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://a.net/"), (3, URLS[3]), (6, URLS[6]), (6, URLS[6])]
    pages = spark.createDataFrame([(*r, "h", "r") for r in rows], "page_id long, url string, host string, rule string")
    ruled = spark.createDataFrame(table, "host string, path string, verdict string")
    got = Counter(tuple(r) for r in urls.filter_urls(pages, ruled).collect())
    assert got == Counter((i, *brute_url(u, table)) for i, u in rows)
    assert urls.filter_urls(pages.limit(0), ruled).count() == 0


def test_url_rules_with_other_letters_and_splits(spark):
    table = [("net", "work/", "block"), ("Äb.DE", "/", "block"), ("ä.org", "/x", "block"), ("a.net?", "/q", "block")]
    rows = list(enumerate(["http://network/x", "http://net/work/", "http://x.ÄB.de/", "http://x.Äb.de/", "http://x.äb.de/", "http://Ä.org/x", "http://ä.ORG/xy", "http://a.net/q", "http://a.net?/q", "http://networ/k/"]))
    got = {r[0]: tuple(r)[1:] for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(table, "host string, path string, verdict string")).collect()}
    lowered = [("".join(c.lower() if c.isascii() else c for c in h), p, v) for h, p, v in table]
    assert got == {i: brute_url(u, lowered) for i, u in rows}
    assert [i for i in got if got[i][3] == "block"] == [2, 3, 6]


# mixing ----------------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(spark, make_docs):
    rng = random.Random(5)
    rows, i = [], 0
    for source, n in [("b", 900), ("a", 40), ("", 30), ("é", 25), (None, 60), ("z", 1), ("empty", 3)]:
        for _ in range(n):
            rows.append((i, None if source == "empty" else " ".join(["w"] * rng.randrange(0, 120)), source))
            i += 1
    rows += [(7, rows[7][1], "b"), (None, "a b c", "a"), (5000, "w " * 30000, "b")]
    df = make_docs(rows)
    got = mixing.mix_sources(df.repartition(5)).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df).collect()))
    sizes, taken, most = Counter(), Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
        most[s] = max(most[s], len(WORD.findall(t or "")))
    want = brute_targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    total = 1.5 * sum(sizes.values())
    assert total - max(most.values()) <= sum(taken.values()) <= total
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * max(most.values())
    assert mixing.mix_sources(make_docs([])).count() == 0
    assert [r.taken for r in mixing.mix_sources(make_docs([(1, None), (2, " ")])).collect()] == [0, 0]


def test_slices_and_null_ids(spark, make_docs, monkeypatch):
    rng = random.Random(9)
    rows = [(None if i % 3 else i, f"t{i} " + "w " * rng.randrange(0, 40), "ab"[i % 2]) for i in range(3000)]
    plain = sorted(map(str, mixing.mix_sources(make_docs(rows)).collect()))
    monkeypatch.setattr(mixing, "SLICE", 20)
    monkeypatch.setattr(mixing, "PARTS", 16)  # several runs of slices, and several steps towards the cut
    assert sorted(map(str, mixing.mix_sources(make_docs(rows).repartition(3)).collect())) == plain
    sums = spark.createDataFrame([(1, s, 10 + s) for s in range(100)] + [(2, 40, 5), (2, 99, 7)], "rank int, slice long, words long")
    got = {(r["rank"], r["slice"]): r["start"] for r in mixing.slice_starts(sums).collect()}
    assert got == {(1, s): sum(10 + k for k in range(s)) for s in range(100)} | {(2, 40): 0, (2, 99): 5}


# quality rules ---------------------------------------------------------------------------------


def brute_rules(text):
    t = text or ""
    ws = WORD.findall(t)
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    base = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), base


def test_rules(spark, make_docs):
    rng = random.Random(8)
    texts = [None, "", " \x0b\x0c\r\n", "one", "a b c d e a b c d e", "a " * 9, "a " * 10, "\xa0x y " * 4, "l1 x\nl1 x\n\nl1 x\n \n", "#*$%&|<> " * 12]
    for _ in range(40):
        texts.append(rng.choice([" ", "\n", "\t "]).join(rng.choices("the of w1 w2 w3 é😀 | THE and".split(), k=rng.randrange(5, 300))))
    texts.append(" ".join(f"w{i}" for i in range(30000)) + " " + " ".join(f"w{i}" for i in range(20)))
    texts.append("x y z the of " * 20000)
    got = {r.doc_id: r for r in rules.quality_rules(make_docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(t), repr(t)[:80]
        assert r.kept == (not r.base_failed and not r.failed)
    clean = "The quick brown fox and a lazy dog went to the river in the morning, and found that it was dry."
    junk = "buy### now$$$ cheap%%% the&&& pills*** and### more### stuff$$$ here%%% of&&& it###"
    a, b = rules.quality_rules(make_docs([(1, clean), (2, junk), (2, junk)])).orderBy("doc_id").collect()[:2]
    assert a.kept and not b.kept and not b.base_failed
    assert rules.quality_rules(make_docs([])).count() == 0


def test_other_rule_tables(spark, make_docs):
    rows = [(1, "the a b c"), (2, "the the the x"), (3, "a | b | c"), (4, None)]
    got = {r.doc_id: r for r in rules.quality_rules(make_docs(rows), base=[("pipe_ratio", ">", 0.3), ("n_words", "<", 1)], table_=[("n_words", ">", 4)]).collect()}
    assert [got[i].base_failed for i in (1, 2, 3, 4)] == [False, False, True, True] and got[3].failed == ["pipe_ratio > 0.3", "n_words > 4"]
    edge = " ".join(["w1 w2"] * 0 + [f"v{i}" for i in range(199)] + ["the"])  # one stop word in 200: just at the threshold
    under = edge + " " + " ".join(f"u{i}" for i in range(5))
    got = {r.doc_id: r.failed for r in rules.quality_rules(make_docs([(1, edge), (2, under)])).collect()}
    assert got[1] == [] and got[2] == ["long_stop_ratio < 0.005"]


# SQL and registered queries --------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_its_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(names).collect())) == Counter(want.fetchall())
