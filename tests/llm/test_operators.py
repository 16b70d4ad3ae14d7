"""The training-data operators on small tables: defined results for every odd case, and brute force where it is feasible."""

import datetime as dt
import random
from array import array
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loregrid.llm import boilerplate, conversations, history_dedup, leakage, packing, pair_defects, scan_repair, spam

T = dt.datetime(2024, 1, 1)
MESSAGE = "id long, chat_id long, role string, content string, timestamp timestamp, extra string"


def chat(spark, *rows):
    """rows: (id, chat_id, role, content, seconds or None)."""
    return spark.createDataFrame([(i, c, r, t, None if s is None else T + dt.timedelta(seconds=s), "x") for i, c, r, t, s in rows], MESSAGE)


def turns(spark, *rows):
    return sorted((r.chat_id, r.turn_no, r.message_id) for r in conversations.conversations(chat(spark, *rows)).collect())


def test_conversation_order_copies_and_retries(spark):
    rows = [
        (1, 1, "system", "s", 0), (2, 1, "User ", "hi", 1), (2, 1, "User ", "hi", 1), (3, 1, "human", " hi\n", 2), (4, 1, "Bot", "yes", 3),
        (5, 1, "user", "late", None), (6, 1, "assistant", "ok", 3),
    ]
    # message 5 takes the time of 4 and stands behind it by its id
    assert turns(spark, *rows) == [(1, 1, 1), (1, 2, 2), (1, 3, 4), (1, 4, 5), (1, 5, 6)]


@pytest.mark.parametrize(
    "rows",
    [
        [(1, 1, "user", "a", 0)],
        [(1, 1, "bot", "a", 0), (2, 1, "user", "b", 1)],
        [(1, 1, "user", "a", 0), (2, 1, "bot", "​ ", 1)],
        [(1, 1, "user", "a", 0), (2, 1, None, "b", 1)],
        [(1, 1, "user", "a", 0), (2, 1, "bot", None, 1)],
        [(1, 1, "system", "a", 0)],
        [(1, 1, "user", "a", 0), (2, 1, "system", "b", 1), (3, 1, "bot", "c", 2)],
        [(1, None, "user", "a", 0), (2, None, "bot", "b", 1)],
    ],
)
def test_unsound_conversations(spark, rows):
    assert turns(spark, *rows) == []


def test_conversations_of_an_empty_table(spark):
    assert conversations.conversations(chat(spark, (1, 1, "user", "a", 0)).limit(0)).count() == 0


def test_conversations_do_not_depend_on_segments(spark):
    random.seed(3)
    rows = [(i, 7 if i % 3 else i, random.choice(["user", "bot"]), random.choice("abc"), random.choice([None, *range(40)])) for i in range(1, 300)]
    found = {(r.chat_id, r.turn_no, r.message_id) for r in conversations.turns(chat(spark, *rows)).collect()}
    want = set()
    chats = {}
    for i, c, r, t, s in rows:
        chats.setdefault(c, []).append([i, r, t, s])
    for c, ms in chats.items():
        last = None
        for m in ms:
            m[3] = last = m[3] if m[3] is not None else last
        n, before = 0, None
        for i, r, t, _ in sorted(ms, key=lambda m: (m[3] is not None, m[3] or 0, m[0])):
            if (r, t) != before:
                n, run = n + 1, []
            run.append(i)
            before = (r, t)
            want = {x for x in want if x[:2] != (c, n)} | {(c, n, min(run))}
    assert found == want


def test_fold_events(spark):
    log = spark.createDataFrame([(1, 1, "create", "a"), (1, 2, "edit", "b"), (2, 1, "create", "c"), (2, 2, "delete", None), (3, 1, "create", "d"), (3, 1, "create", "d"), (None, 1, "create", "e")], "id long, version int, op string, text string")
    assert sorted((r.id, r.text) for r in conversations.fold_events(log, "id", ["version"], "op").collect()) == [(1, "b"), (3, "d")]


def test_dedup_in_batches_is_dedup_at_once(spark):
    random.seed(5)
    words = [w + v for w in "lorem ipsum dolor amet elit sed tempor magna aliqua quis nostrud".split() for v in ("a", "be", "cu", "do", "ex")]
    bodies = []
    for i in range(1, 61):
        if i > 10 and i % 3 == 0:
            lines = [x.split(" ") for x in bodies[i % 10][1].split("\n")]
            random.choice(lines)[0] = "changed"
            random.shuffle(lines)
        else:
            lines = [[random.choice(words) for _ in range(14)] for _ in range(4)]
        bodies.append((i, "\n".join(history_dedup.normal_lines("\n".join(" ".join(x) for x in lines)))))
    df = spark.createDataFrame(bodies, "id long, body string")
    whole = {(r.id, r.first_id) for r in history_dedup.match(df)[0].collect()}
    index, parts = None, set()
    for a in range(0, 61, 20):
        found, index = history_dedup.match(df.filter((F.col("id") > a) & (F.col("id") <= a + 20)), index)
        parts |= {(r.id, r.first_id) for r in found.collect()}
    brute, firsts = set(), []
    for i, b in bodies:
        first = next((j for j, x in firsts if history_dedup.same_body(x, b)), None)
        if first is None:
            firsts.append((i, b))
        else:
            brute.add((i, first))
    assert brute and whole == brute and parts == brute


def test_dedup_meets_pages_whose_segments_stood_before(spark):
    line = lambda p, i: " ".join(f"{p}{chr(97 + i)}{chr(97 + j)}" for j in range(14))
    # every line of page 8 stood in another page before, two of each segment's owners are never near it
    others = [(k + 1, "\n".join(sorted([line("m", k), *[line(f"o{chr(97 + k)}", i) for i in range(7)]]))) for k in range(7)]
    eighth = "\n".join(line("m", i) for i in range(7))
    rows = [*others, (8, eighth), (9, eighth.replace("maa", "x"))]
    found, _ = history_dedup.match(spark.createDataFrame(rows, "id long, body string"))
    assert [(r.first_id, r.id) for r in found.collect()] == [(8, 9)]


def test_dedup_of_chained_edits_in_batches(spark):
    line = lambda p, i: " ".join(f"{p}{chr(97 + i)}{chr(97 + j)}" for j in range(14))
    a = [line("m", i) for i in range(8)]
    # the last body has segments in common with the edited lines of the second only
    b = [" ".join("q" + w if i > 1 and j in (2, 9) else w for j, w in enumerate(x.split(" "))) for i, x in enumerate(a)]
    c = [" ".join("r" + w if i < 2 and j in (2, 9) else w for j, w in enumerate(x.split(" "))) for i, x in enumerate(b)]
    a, b, c = ("\n".join(sorted(x)) for x in (a, b, c))
    assert history_dedup.same_body(a, b) and history_dedup.same_body(b, c)
    df = spark.createDataFrame([(1, a), (2, b), (3, "\n".join(line("z", i) for i in range(8))), (4, c), (5, b)], "id long, body string")
    index, parts = None, set()
    for batch in ("id < 3", "id = 3", "id > 3"):
        found, index = history_dedup.match(df.filter(batch), index)
        parts |= {(r.first_id, r.id) for r in found.collect()}
    assert parts == {(r.first_id, r.id) for r in history_dedup.match(df)[0].collect()} == {(1, 2), (1, 4), (1, 5)}


def test_dedup_of_short_bodies(spark):
    line = lambda p, n: " ".join(f"{p}{chr(97 + j)}" for j in range(n))
    bodies = [line("m", 8), line("m", 8).replace("mc", "x"), "\n".join(sorted(["aa ab", "ac ad", "ae", "af ag ah"])), "\n".join(sorted(["aa ab", "ac ad", "ae", "af ag x", "ai"])), line("m", 8).replace("mc", "x").replace("mf", "y").replace("mh", "z")]
    df = spark.createDataFrame(list(enumerate(bodies, 1)), "id long, body string")
    found = {(r.first_id, r.id) for r in history_dedup.match(df)[0].collect()}
    want = {(i, j) for j in range(1, 6) for i in range(1, j) if history_dedup.same_body(bodies[i - 1], bodies[j - 1])}
    assert want == {(1, 2), (3, 4), (2, 5)} and found == {(1, 2), (3, 4), (1, 5)}


def test_dedup_near_bodies_of_random_edits(spark):
    random.seed(12)
    words = ["".join(random.choice("bcdfghjklmnprstvw") + random.choice("aeiou") for _ in range(3)) for _ in range(400)]
    bodies, firsts = [], []
    for i in range(1, 241):
        if i > 60:
            lines = [x.split(" ") for x in firsts[i % 60]]
            flat = [(a, b) for a, x in enumerate(lines) for b in range(len(x))]
            for a, b in random.sample(flat, int(random.random() * 0.15 * len(flat))):
                lines[a][b] = random.choice(words)
            random.shuffle(lines)
            bodies.append("\n".join(sorted(" ".join(x) for x in lines)))
        else:
            firsts.append([" ".join(random.choice(words) for _ in range(random.randint(2, 20))) for _ in range(random.randint(1, 12))])
            bodies.append("\n".join(sorted(firsts[-1])))
    df = spark.createDataFrame(list(enumerate(bodies, 1)), "id long, body string")
    index, got = None, {}
    for a, b in ((0, 90), (90, 150), (150, 240)):
        found, index = history_dedup.match(df.filter((F.col("id") > a) & (F.col("id") <= b)), index)
        got |= {r.id: r.first_id for r in found.collect()}
    near = [i for i in range(61, 241) if history_dedup.same_body(bodies[i % 60], bodies[i - 1])]
    assert len(near) > 150 and sum(got.get(i) == i % 60 + 1 for i in near) >= 0.97 * len(near)


def test_dedup_moves_probes_packed_in_any_number_of_buckets(spark, monkeypatch):
    line = lambda p, i: " ".join(f"{p}{chr(97 + i)}{chr(97 + j)}" for j in range(14))
    page = lambda p: "\n".join(line(p, i) for i in range(8))
    df = spark.createDataFrame([(i, page("abcde"[i % 5]).replace("ab", f"x{i}" if i % 3 else "ab")) for i in range(1, 21)], "id long, body string")
    found = []
    for buckets in (1, 5):
        monkeypatch.setattr(history_dedup, "LEAST_BUCKETS", buckets)
        out, index = history_dedup.match(df)
        # one row for each bucket, whatever the number of keys
        assert index.buckets == buckets and index.firsts.count() <= buckets
        found.append(sorted(tuple(r) for r in out.collect()))
    assert found[0] == found[1] and len(found[0]) == 15


@pytest.mark.parametrize("block", [1, 7, 1_000])
def test_dedup_pairs_probes_with_all_owners_in_blocks(monkeypatch, block):
    random.seed(3)
    monkeypatch.setattr(history_dedup, "BLOCK_PAIRS", block)
    own = sorted({(random.randint(-4, 4), random.randint(1, 30)): random.randint(1, 2) for _ in range(90)}.items())
    probes = sorted({(random.randint(-5, 5), random.randint(1, 30)) for _ in range(60)})
    cell = lambda values, kind="q": array(kind, values).tobytes()
    rows = [(0, history_dedup.OWN, cell([k for (k, _), _ in x]), cell([i for (_, i), _ in x]), b"", cell([w for _, w in x], "i")) for x in (own[:40], own[40:])]
    rows.append((0, history_dedup.PROBE, cell([k for k, _ in probes]), cell([i for _, i in probes]), b"", b""))
    out = history_dedup._owners(5)(history_dedup._frame(rows))
    want = Counter()
    for k, page in probes:
        want.update({(page, i): w for (key, i), w in own if key == k and i < page})
    got = Counter()
    for r in out.itertuples():
        for page, first, w in zip(array("q", r.ids), array("q", r.firsts), array("i", r.weights)):
            got[page, first] += w
    assert got == want and all(page % 5 == r.bucket for r in out.itertuples() for page in array("q", r.ids))


def test_dedup_keeps_owners_packed_and_what_is_new_only(spark):
    line = lambda p, i: " ".join(f"{p}{chr(97 + i)}{chr(97 + j)}" for j in range(14))
    page = lambda p: "\n".join(line(p, i) for i in range(8))
    # one word of a page is another: of its 16 segments one is new
    df = spark.createDataFrame([(1, page("a")), (2, page("a").replace("aab", "x")), (3, page("b"))], "id long, body string")
    index = history_dedup.match(df)[1]
    owned = Counter(i for r in index.segments.collect() for i in array("q", bytes(r.ids)))
    assert owned == {1: 16, 2: 1, 3: 16}


def test_repeated_pages_by_runs(spark):
    line = lambda p, i: " ".join(f"{p}{chr(97 + i)}{chr(97 + j)}" for j in range(14))
    page = lambda p: "\n".join(line(p, i) for i in range(8))
    rows = [(i, None if i == 1 else i // 4, None, f"t{i}", page("abcdefgh"[i % 8]).replace("aa", f"x{i}" if i % 3 else "aa")) for i in range(1, 41)]
    raw = spark.createDataFrame(rows, "id long, bot_run_id long, url string, title string, content string")
    ranges = history_dedup.run_ranges(raw)
    # cuts are first ids of runs
    assert len(ranges) == 4 and all(end is None or end % 4 == 0 for _, end in ranges)
    one, four = (sorted(tuple(r) for r in history_dedup.repeated_pages(raw, n).collect()) for n in (1, 4))
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst", None) in (None, "true")
    assert one == four and len(one) == 32 and all(a == (b % 8 or 8) for a, b in one)


def test_same_body_bounds():
    a = "\n".join(f"w{i}a w{i}b w{i}c w{i}d" for i in range(5))
    assert history_dedup.same_body(a, "\n".join(reversed(a.split("\n"))))
    assert history_dedup.same_body(a, a.replace("w0a", "x").replace("w1a", "x"))
    assert not history_dedup.same_body(a, a.replace("a", "x").replace("b", "y"))
    assert history_dedup.normal_lines("B, a!\n\n 12 \nA-c") == ["a c", "b a"]


def test_repeated_pages_exact_nulls_and_empty(spark):
    schema = "id long, url string, title string, content string"
    raw = spark.createDataFrame([(1, None, None, "same text of a page"), (2, "u", "t", "same text of a page"), (3, None, None, None), (4, None, None, None), (5, None, None, ""), (6, None, None, "")], schema)
    assert sorted(tuple(r) for r in history_dedup.repeated_pages(raw).collect()) == [(1, 2), (5, 6)]
    assert history_dedup.repeated_pages(raw.limit(0)).count() == 0


PAGE = "page_id long, pdf_id long, source_file string, page_number int, text string"


def test_scan_kinds(spark):
    body = "the old mill grinds the grain of the valley every day"
    words = [body] * 12
    pages = [(n, 1, None, n, "\n".join([f"ANNUAL REPORT  {n}", *words, "people often cross the con-" if n == 1 else "the valley is wide", f"- {n} -"])) for n in range(1, 4)]
    pages[1] = (2, 1, None, 2, pages[1][4].replace(f"ANNUAL REPORT  2\n{body}", "ANNUAL REPORT  2\nsignment to the va1ley of gra|n", 1))
    other = [(10 + n, 2, None, n, "\n".join(["a consignment of the valley", *["the consignment is in the valley of grain"] * 6])) for n in range(1, 4)]
    odd = [(90, None, None, None, None), (91, None, None, 1, ""), (92, 3, None, 1, " \n\n")]
    got = {(r.page_id, r.line_no, r.kind) for r in scan_repair.found(spark.createDataFrame(pages + other + odd, PAGE)).collect()}
    assert {(n, 1, "running") for n in (1, 2, 3)} | {(n, 15, "running") for n in (1, 3)} <= got
    assert (1, 14, "split") in got and (2, 2, "misread") in got
    assert not any(p >= 90 for p, _, _ in got)
    assert scan_repair.found(spark.createDataFrame(pages, PAGE).limit(0)).count() == 0


def test_misread_at_line_ends(spark):
    body = ["the old mill grinds the grain of the valley every day"] * 8 + ["the old mill-grain of the valley is sold"] * 6
    odd = ["va1ley grinds of the old grain", "every day the old gra1n.", "the old mill-", "grain of the valley every day"]
    pages = spark.createDataFrame([(1, 1, None, 1, "\n".join([*body, *odd, *body]))], PAGE)
    kinds = [(r.line_no, r.kind) for r in scan_repair.found(pages).collect() if 15 <= r.line_no <= 18]
    assert sorted(kinds) == [(15, "misread"), (16, "misread")]
    text = {r.line_no: r.text for r in scan_repair.repaired_lines(pages).collect()}
    assert (text[15], text[16], text[17]) == ("valley grinds of the old grain", "every day the old grain.", "the old mill-")


def test_misread_forms_are_chosen_by_their_neighbours(spark):
    body = ["we saw the modern house of glass on the hill"] * 9 + ["she has a modem for the network in the hall"] * 6
    odd = ["today the moclem house of glass is closed", "there is a moclern for the network in the box"]
    pages = spark.createDataFrame([(1, 1, None, 1, "\n".join([*body, *odd, *body]))], PAGE)
    text = {r.line_no: r.text for r in scan_repair.repaired_lines(pages).collect()}
    assert (text[16], text[17]) == ("today the modern house of glass is closed", "there is a modem for the network in the box")


def test_paragraphs(spark):
    text1 = "The grain of the valley is ground at the old mill and the con-\nsignment leaves by boat.\n\nA second paragraph runs on over the\nend of the page and does not"
    text2 = "stop before the well-\nknown bridge is reached by all."
    more = [(9, 2, None, 1, "\n".join(["every consignment of the valley stops at the well-known bridge here"] * 8))]
    pages = spark.createDataFrame([(1, 1, None, 1, text1), (2, 1, None, 2, text2), (3, 1, None, 2, text2), *more], PAGE)
    got = [r.text for r in scan_repair.paragraphs(pages).filter("pdf_id = 1").orderBy("para_no").collect()]
    assert got == [
        "The grain of the valley is ground at the old mill and the consignment leaves by boat.",
        "A second paragraph runs on over the end of the page and does not stop before the well-known bridge is reached by all.",
    ]


PAIR = "id long, q string, a string, defects string"


@pytest.mark.parametrize(
    "q,a,defect",
    [
        ("How deep is the lake?", None, "empty"), ("How deep is the lake?", " \n", "empty"), ("How deep is the lake?", "<p></p>", "empty"), ("How deep is the lake?", "N/A", "empty"),
        ("How deep is the lake?", '{"answer": ""}', "empty"), ("How deep is the lake?", "how deep is the lake", "copy"), ("How deep is the lake?", "You asked: How deep is the lake?", "copy"),
        ("How deep is the lake?", "I'm sorry, but I cannot answer this question.", "refusal"), ("Wie tief ist der See?", "Leider kann ich dabei nicht helfen.", "refusal"),
        ("Quelle est la profondeur?", "Désolé, je ne peux pas répondre à cette question.", "refusal"), ("¿Qué tan hondo es?", "Lo siento, no puedo responder a esta pregunta.", "refusal"),
        ("How deep is the lake?", "The lake is between nine and ten metres deep, and the", "truncated"), ("How deep is the lake?", "It is deep (very", "truncated"),
        ("How deep is the lake?", '{"answer": "The lake is', "truncated"), ("How deep is the lake?", "```\ncode", "truncated"),
        ("How deep is the lake?", "Der See ist an der tiefsten Stelle neun Meter tief und im Winter nicht offen.", "other_language"),
        ("How deep is the lake?", "Yes.", None), ("How deep is the lake?", "9 metres", None), ("How deep is the lake?", "How deep is the lake? It is nine metres deep at the mill.", None),
        ("How deep is the lake?", "I can't stress this enough: the lake is deep.", None), ("Please translate into German: the lake is deep.", "Der See ist nicht tief und die Ufer sind flach.", None),
        (None, "The lake is deep.", None), ("", "The lake is deep.", None),
    ],
)
def test_pair_defects(spark, q, a, defect):
    found = pair_defects.first_defect(spark.createDataFrame([(1, q, a, "clash")], PAIR).drop("defects"), "q", "a").collect()
    assert [r.defect for r in found] == ([defect] if defect else [])


def test_refusal_of_any_length(spark):
    said = "I'm sorry, but I cannot answer this question. I am not able to help. We can't discuss this. Unfortunately, I cannot comment on that. I will not provide it. I must decline to answer."
    df = spark.createDataFrame([(1, "How deep is the lake?", said), (2, "How deep is the lake?", said + " The lake is nine metres deep at the mill.")], "id long, q string, a string")
    assert [(r.id, r.defect) for r in pair_defects.first_defect(df, "q", "a").collect()] == [(1, "refusal")]


def test_other_script(spark):
    rows = [
        ("How deep is the lake?", "Озеро имеет глубину девять метров."), ("How deep is the lake?", "湖深九米，冬天不开放。"), ("Какова глубина озера?", "It is nine metres deep at the mill."),
        ("How deep is the lake?", "Nine metres (Russian: озеро)."), ("How deep is the lake?", "9"), ("Translate into Russian: the lake is deep, then translate it back.", "Озеро глубокое."), ("湖有多深？", "湖深九米。"),
    ]
    df = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(rows)], "id long, q string, a string")
    got = {r.id: r.defects for r in pair_defects.pair_defects(df, "q", "a").collect()}
    assert [i for i in sorted(got) if "other_language" in got[i]] == [0, 1, 2]


def test_every_triggered_defect(spark):
    rows = [("How deep is the old lake at the mill (in metres", "how deep is the old lake at the mill (in metres"), ("How deep is the lake?", '{"answer": "'), ("Wie tief ist der See und wo ist die Mühle?", "I cannot answer this question, and")]
    df = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(rows)], "id long, q string, a string")
    got = {r.id: r.defects for r in pair_defects.pair_defects(df, "q", "a").collect()}
    assert got[0] == ["copy", "truncated"] and "truncated" in got[1] and {"refusal", "truncated", "other_language"} == set(got[2])


def test_pair_defects_long_and_empty(spark):
    df = spark.createDataFrame([(1, "q", "The lake is deep. " * 20_000, "x")], PAIR).drop("defects")
    assert pair_defects.first_defect(df, "q", "a").count() == 0
    assert pair_defects.first_defect(df.limit(0), "q", "a").count() == 0


def test_boilerplate(spark):
    random.seed(1)
    words = "granite river lantern orchard copper meadow window harvest falcon ember willow marble".split()
    rows = []
    for i in range(40):
        body = [" ".join(random.choice(words) + random.choice("abcdefgh") for _ in range(14)).capitalize() + "." for _ in range(3)]
        title = f"{random.choice(words)}{i} {random.choice(words)}x".capitalize()
        rows.append(("raw_data", i, f"https://site{i % 9}.example/{i}", title, "\n".join(["Home | About us | Contact", title, *body, "Subscribe to our weekly letter today", "Back to top"])))
    rows += [("raw_data", 100, None, None, None), ("raw_data", 101, "", "", ""), ("raw_data", 102, "not a url", None, "\n \n")]
    pages = spark.createDataFrame(rows, "src string, row_id long, url string, title string, content string")
    got = {(r.row_id, r.line_no) for r in boilerplate.boilerplate_lines(pages).collect()}
    assert got == {(i, n) for i in range(40) for n in (1, 6, 7)}
    assert boilerplate.boilerplate_lines(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_no_boilerplate(spark):
    body = "Alpha beta gamma delta epsilon zeta eta theta iota kappa.\nLambda mu nu xi omicron pi rho sigma tau upsilon."
    rows = [("raw_data", i, f"https://a{i}.example/", "One title", f"One title\n{body}") for i in range(30)]
    pages = spark.createDataFrame(rows, "src string, row_id long, url string, title string, content string")
    assert boilerplate.boilerplate_lines(pages).count() == 0


DOC = "doc_id long, text string, bin string, tokens string"


def test_packing_is_valid(spark):
    random.seed(4)
    docs = [(i, "word " * random.randint(0, 700), "b", "t") for i in range(200)] + [(500, None, "b", "t"), (501, "", "b", "t"), (7, "again " * 9, "b", "t")]
    sizes = spark.createDataFrame([(1, 256), (2, 1000), (3, None), (4, 0)], "size_id int, max_tokens int")
    out = packing.packed(spark.createDataFrame(docs, DOC), sizes).collect()
    counts = {}
    for r in packing.token_counts(spark.createDataFrame(docs, DOC)).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.tokens
    for size, cap in ((1, 256), (2, 1000)):
        rows = [r for r in out if r.size_id == size]
        fill, held = {}, {}
        for r in rows:
            fill[r.bin] = fill.get(r.bin, 0) + r.tokens
            held[r.doc_id] = held.get(r.doc_id, 0) + r.tokens
            assert r.piece == 0 or counts[r.doc_id] > cap
        assert held == counts and max(fill.values()) <= cap
        assert len([b for b in fill if fill[b]]) <= -(-sum(counts.values()) // cap) + 2
    assert {r.size_id for r in out} == {1, 2}
    assert packing.packed(spark.createDataFrame(docs, DOC).limit(0), sizes).count() == 0


def test_packing_report_and_no_sizes(spark):
    random.seed(5)
    docs = spark.createDataFrame([(i, "word " * random.randint(20, 60)) for i in range(300)], "doc_id long, text string")
    sizes = spark.createDataFrame([(1, 100)], "size_id int, max_tokens int")
    (r,) = packing.search_report(docs, sizes).collect()
    # the search, not the fit it starts from, makes the packing
    assert r.least <= r.bins < r.start and r.move + r.exchange + r.two_for_one + r.one_for_two > 0
    assert r.bins == packing.packed(docs, sizes).select("bin").distinct().count()
    assert packing.packed(docs, sizes.limit(0)).count() == 0 and packing.packed(docs.limit(0), sizes).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_local_search_never_loses_items(seed):
    random.seed(seed)
    sizes = [random.randint(20, 60) for _ in range(60)]
    start = packing.best_fit(sizes, 100)
    end = packing.improve(sizes, start, 100, rounds=20)
    assert sorted(i for b in end for i in b) == list(range(60)) and all(sum(sizes[i] for i in b) <= 100 for b in end)
    squared = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)
    assert len(end) <= len(start) and squared(end) >= squared(start)


def test_local_search_empties_a_bin():
    # two bins of slack whose contents fit into one after an exchange of one for two
    sizes = [50, 30, 10, 40, 35, 20, 15]
    assert len(packing.improve(sizes, [[0, 1, 2], [3, 4], [5, 6]], 100, rounds=10)) == 2


def test_exchanges_look_at_sizes_that_fit_only():
    import numpy as np

    random.seed(14)
    for _ in range(40):
        sizes = np.array([random.randint(0, 60) for _ in range(50)], np.int64)
        state = packing.Bins(sizes, packing.fit([int(x) for x in sizes], 100), 100)
        pool = packing.Choices(sizes, np.arange(50), np.arange(50))
        home = int(np.argmin(state.fill))
        most = state.most_room(home)
        for size in range(1, 90):
            # brute force: the first of the items whose exchange increases squared fill most
            worth = [(size - int(sizes[i])) * int(state.fill[b] - state.fill[home] + size - sizes[i]) if b != home and state.fill[b] and 0 < size - sizes[i] <= 100 - state.fill[b] else 0 for i, b in enumerate(state.of)]
            best, found = state._best(size, home, most, pool)
            assert max(best, 0) == max(0, *worth) and (best <= 0 or found == worth.index(best))


def test_leakage(spark):
    random.seed(6)
    vocabulary = [a + b for a in "ka lo mi nu pe ra so tu".split() for b in "ban dor fel gim hup".split()]
    say = lambda n: [random.choice(vocabulary) for _ in range(n)]
    passages = [say(60) for _ in range(4)]
    stock = "Read this and answer."
    items = [(i, f"{stock}\n{' '.join(p)}") for i, p in enumerate(passages)] + [(8, None), (9, "")]
    noisy = [w if k % 7 else "other" for k, w in enumerate(passages[1][:40])]
    docs = [
        (1, " ".join(say(200) + passages[0] + say(50))), (2, " ".join(say(30)) + " <b>" + "</b>\\n&amp; ".join(w.upper() for w in noisy)), (3, " ".join(say(10) + passages[2][:15] + say(40))),
        (4, " ".join(passages[3][:14] + say(60) + passages[3][30:44])), (5, stock + " " + " ".join(say(80))), (6, None), (7, ""), (None, " ".join(passages[0])),
    ]
    it = spark.createDataFrame(items, "item_id long, passage string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = {(r.item_id, r.doc_id) for r in leakage.leaked(df, it).collect()}
    assert got == {(0, 1), (1, 2), (3, 4)}
    assert leakage.leaked(df.limit(0), it).count() == 0 and leakage.leaked(df, it.limit(0)).count() == 0
    left = leakage.without_leaks(df.filter("doc_id IS NOT NULL"), leakage.leaked(df, it))
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 6, 7]


def test_spam(spark):
    random.seed(7)
    nouns = "lamp table river stone garden window".split()
    prose = lambda: " ".join(f"The {random.choice(nouns)} of the {random.choice(nouns)} is near the {random.choice(nouns)} and it was built by hand." for _ in range(8))
    stuffed = lambda: " ".join(random.choice(["cheap", "buy", "best", "lamp", "lamp", "lamp"]) for _ in range(80))
    links = lambda: "\n".join(f"[{random.choice(nouns)} {k}](http://a{k}.example/x)" for k in range(20))
    docs = [(i, f"host{i % 5}", prose() if i % 4 else stuffed() if i % 8 else links()) for i in range(80)]
    docs += [(100, None, None), (101, "h", ""), (102, "h", "word"), (103, None, "lamp " * 30_000)]
    got = {r.page: r.spam for r in spam.judged(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(80))
    assert not (got[100] or got[101] or got[102]) and got[103]


def test_spam_of_one_class_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "h", "The lamp of the house is old and it is near the river.")], "doc_id long, source string, text string")
    assert [r.spam for r in spam.judged(df).collect()] == [False]
    assert spam.judged(df.limit(0)).count() == 0


def test_spam_of_sentences_made_of_a_keyword(spark):
    random.seed(8)
    nouns = "lamp table river stone garden window kettle bridge".split()
    prose = lambda: " ".join(f"The {random.choice(nouns)} of the {random.choice(nouns)} is near the {random.choice(nouns)} and it was built by hand in {random.randint(1, 99)} days." for _ in range(12))
    preach = lambda w: " ".join(random.choice([f"Looking for {w}? Our {w} shop has {w} and more {w} today.", f"With {w} from us your {w} stays a fine {w}.", f"Our {w} is the best {w} for every {w} buyer."]) for _ in range(9))
    docs = [(i, f"host{i % 5}", preach(random.choice(nouns)) if i % 3 == 0 else prose()) for i in range(90)]
    # a paragraph that says something before more keywords than that, and fewer
    docs += [(200, "host1", prose()[:150] + ". " + preach("lamp")), (201, "host1", prose() + " " + prose() + " Our lamp is the best lamp for every lamp buyer.")]
    pages = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = {r.page: r.spam for r in spam.judged(pages).collect()}
    assert all(got[i] == (i % 3 == 0) for i in range(90)) and got[200] and not got[201]
    found = spam.features(pages)
    known = {r.page: r.label for r in found.select("page", spam.weak_label().alias("label")).collect()}
    # the rules leave pages open that the trees judge
    assert any(known[p] is None and got[p] for p in got)
    assert {(r.label, r.said) for r in spam.held_out(found).collect()} <= {(0.0, 0.0), (1.0, 1.0)}


def test_leakage_of_short_passages(spark):
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    say = lambda n: [word() for _ in range(n)]
    eight, two, long = say(8), say(2), say(24)
    items = spark.createDataFrame([(1, " ".join(eight)), (2, " ".join(two)), (3, " ".join(long))], "item_id long, passage string")
    docs = [
        (1, " ".join(say(30) + eight + say(30))), (2, " ".join(say(5) + two + say(5))), (3, " ".join(say(12) + long[6:15] + say(12))), (4, " ".join(say(12) + long[6:12] + say(12))),
        (5, " ".join(eight[:4] + say(3) + eight[4:])), (6, " ".join(eight)),
    ]
    got = {(r.item_id, r.doc_id): (r.held, r.at, r.place, r.longest) for r in leakage.leaked(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got.keys() == {(1, 1), (2, 2), (3, 3), (1, 5), (1, 6)}
    # the longest verbatim match and where it stands
    assert got[1, 1] == (8, 0, 30, 8) and got[3, 3] == (9, 6, 12, 9) and got[2, 2] == (2, 0, 5, 2)


def test_verbatim_matches_against_brute_force():
    import numpy as np

    random.seed(10)
    # more different words than any packing of ranks into one key could hold
    rare = [(f"r{i}x", " ".join(f"w{i}a{k}" for k in range(40))) for i in range(1200)]
    words = [random.choice("abc") for _ in range(60)]
    test = leakage.TestSuffixes([(0, " ".join(words)), *[(i + 1, t) for i, (_, t) in enumerate(rare)]])
    assert len(test.vocabulary) > 1 << 15
    docs = [[random.choice("abcz") for _ in range(80)] for _ in range(3)] + [rare[7][1].split()[3:30]]
    stream = np.array([x for t in docs for x in (*(test.vocabulary.get(w, 0) for w in t), 0)], np.int64)
    bounds = np.r_[0, np.cumsum([len(t) + 1 for t in docs])]
    got = {tuple(int(v) for v in x) for x in zip(*leakage._matches(test, stream, bounds))}
    want = {(8, 3, 3, int(bounds[3]), 27)}
    for d, t in enumerate(docs[:3]):
        for i in range(60):
            for j in range(80):
                if i and j and words[i - 1] == t[j - 1]:
                    continue
                n = 0
                while i + n < 60 and j + n < 80 and words[i + n] == t[j + n]:
                    n += 1
                if n >= leakage.SEED:
                    want.add((0, d, i, int(bounds[d]) + j, n))
    assert got == want
