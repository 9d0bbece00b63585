import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skygrid.llm import digests, leakage, mixing, runs, stuffing


# runs of nearly equal readings


@given(st.lists(st.tuples(st.integers(1, 3), st.integers(-12, 12)), max_size=80), st.integers(0, 6), st.integers(1, 2))
@settings(max_examples=80, deadline=None)
def test_machine_and_vectors_agree(steps, tolerance, gap):
    pos = np.cumsum([s for s, _ in steps]) if steps else np.zeros(0, int)
    cents = np.array([v for _, v in steps], int)
    m = runs.RunMachine(tolerance, gap, 3)
    want = [(r[3], r[2]) for p, c in zip(pos.tolist(), cents.tolist()) for r in m.push(p, c)] + [(r[3], r[2]) for r in m.finish()]
    start, n = runs.close_runs(np.zeros(pos.size, int), pos, cents, tolerance, gap, 3)
    assert list(zip(start.tolist(), n.tolist())) == want


def test_runs(obs_of, objects_of):
    extra = [(99, 1, "tmax", None, 1, 1, 2, 1.05, 0, "", "", 0, ""), (98, None, "tmax", None, 1, 1, 2, 1.0, 0, "", "", 0, ""), (97, 1, "tmax", None, None, 1, 2, 1.0, 0, "", "", 0, "")]
    obs = obs_of({(1, "tmax"): [1.0, 1.05, 1.1, 1.16, None, 1.16, 1.16, -999, 1.16], (2, "rain"): [0, 0, 0, 0]}, extra)
    got = sorted(tuple(r)[:6] for r in runs.collapse(obs).collect())
    assert got == [(1, 1, 2, 0, 2, 3), (2, 1, 2, 0, 3, 4)]
    first = sorted((r["object_id"], r["first_pos"], r["last_pos"]) for r in runs.collapse(obs, least=2, anchor="first").collect())
    assert first == [(1, 0, 1), (1, 5, 6), (2, 0, 3)]
    e = {r["object_id"]: r for r in runs.events(obs, objects_of({2: 8})).collect()}
    assert e[2]["share"] == 0.5 and e[2]["last_day"].isoformat() == "2001-01-04" and e[1]["share"] is None
    assert runs.collapse(obs_of({})).count() == 0
    with pytest.raises(ValueError):
        runs.collapse(obs, anchor="middle")


# digests


def test_merged_digests_keep_the_bound():
    r = np.random.default_rng(2)
    v = np.concatenate([r.exponential(10, 20000), np.zeros(9000), r.normal(50, 1, 1000)]).round(2)
    r.shuffle(v)
    parts = [digests.cluster(np.zeros(x.size, int), x, None, 1) for x in np.array_split(v, 37)]
    g, m, w = digests.cluster(np.zeros(sum(p[1].size for p in parts), int), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), 1)
    assert m.size < 250 and w.sum() == v.size
    ps = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    for p, e in zip(ps, digests.quantiles(g, m, w, 1, ps)[0]):
        error = max(0.0, p - (v <= e).mean(), (v < e).mean() - p)
        assert error <= digests.rank_bound(p, v.size)


def test_quantiles_of_many_small_groups():
    g = np.array([0, 1, 1, 1, 2, 2])
    m = np.array([5.0, 1.0, 2.0, 9.0, 3.0, 3.0])
    got = digests.quantiles(g, m, np.ones(6), 3, [0.0, 0.5, 1.0])
    assert got.tolist() == [[5, 5, 5], [1, 2, 9], [3, 3, 3]]


def test_certificates_are_exact_ranks(obs_of, objects_of):
    r = random.Random(4)
    series = {(o, var): [r.choice([None, -999, round(r.gauss(20, 9), 2), 0.0]) for _ in range(40)] for o, var in ((1, "tmax"), (2, "tmax"), (3, "rain"), (4, None))}
    extra = [(900 + p, 1, "tmax", None, p, 1, 2, None if series[1, "tmax"][p] is None else float(series[1, "tmax"][p]), 0, "", "", 0, "") for p in range(40)]
    obs, objects = obs_of(series, extra), objects_of({1: 40, 2: 40, 3: 40})
    blocks = digests.readings(obs, objects)
    grains = ("all", "cell", "day", "object")
    a = digests.named(digests.certify(blocks, digests.digests(blocks, grains), grains))
    groups = {}
    for (o, var), vs in series.items():
        for pos, v in enumerate(vs):
            if v not in (None, -999):
                for key in (("all", var, None, None), ("cell", var, None, None), ("object", var, o, None), *((("day", var, None, pos),) if o != 4 else ())):
                    groups.setdefault(key, []).append(v)
    day0 = __import__("datetime").date(2001, 1, 1)
    got = {(x["grain"], x["var"], x["object_id"], None if x["day"] is None else (x["day"] - day0).days): x for x in a.collect()}
    assert set(got) == set(groups)
    for key, vs in groups.items():
        x, v = got[key], np.array(vs, float)
        error = max(max(0.0, p - (v <= e).mean(), (v < e).mean() - p) for p, e in zip(digests.PERCENTILES, (x[c] for c in ("p05", "p25", "p50", "p75", "p95", "p99"))))
        assert x["n"] == v.size and x["within_bound"] and x["max_rank_error"] == pytest.approx(error)
    kept = digests.named(digests.certify(blocks.where("start is not null"), digests.roll_up(digests.digests(blocks, ["day"])), ["all"]))
    assert {r["var"]: r["n"] for r in kept.collect() if r["var"]} == {v: len(groups["all", v, None, None]) for v in ("tmax", "rain")}


def test_nothing_but_checkpoints_stays(spark, obs_of, objects_of):
    import os

    from skygrid.session import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert digests.percentiles(obs_of({(1, "rain"): [1.0, 2.0]}), objects_of({1: 2})).count() == 4
    assert pairs(spark, [ITEM]) == [(0, 100)]
    assert all(x.count("-") == 4 for x in set(os.listdir(folder)) - before)


def test_no_readings(obs_of, objects_of):
    assert digests.percentiles(obs_of({(1, "rain"): [None, -999]}), objects_of({1: 2})).count() == 0
    assert digests.percentiles(obs_of({}), objects_of({})).count() == 0


# leakage

ITEM = "In the third week every damp canal questioned the weathered parchment, because a velvet apprentice borrowed one estuary across another silent harbour while nobody watched the copper lantern."
SHORT = "A quiet harbour café sold twelve crooked lanterns."


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, eval_id int, words string")


def items_of(spark, texts):
    return spark.createDataFrame([(i + 100, t, 1) for i, t in enumerate(texts)], "eval_id long, text string, doc_id int")


def pairs(spark, texts, items=(ITEM, SHORT), **kw):
    return sorted((r["doc_id"], r["eval_id"]) for r in leakage.leaks(docs_of(spark, texts), items_of(spark, list(items)), **kw).collect())


def test_what_is_no_difference(spark):
    words = ITEM.split()
    cyrillic = ITEM.replace("a", "а").replace("e", "е").replace("o", "о")
    texts = [
        "Nice. " + ITEM + " Bye.",
        "x " + " ".join(words[3:15]) + " y",
        ITEM.upper(),
        "> " + ITEM.replace(" ", "\n> "),
        ITEM.replace("questioned", "ques-\ntioned").replace("estuary", "est-\n> uary"),
        cyrillic,
        ITEM.replace("canal", "ca​nal").replace("velvet", "vel­vet"),
        ITEM.replace("damp canal", "<b>damp</b> canal<br/>").replace("velvet", "&quot;velvet&quot;").replace("one", "&amp;quot;one&amp;quot;"),
        "So: " + SHORT.replace("é", "e") + " Indeed.",
    ]
    assert pairs(spark, texts) == [(i, 100) for i in range(8)] + [(8, 101)]


def test_light_changes_and_what_is_no_case(spark):
    w = ITEM.split()
    changed = w[:16]
    changed[4], changed[11] = "dmap", "blue"
    missing = w[2:9] + w[10:16]
    added = w[2:8] + ["really"] + w[8:15]
    order = w[:14]
    random.Random(2).shuffle(order)
    texts = [" ".join(changed), " ".join(missing), " ".join(added), " ".join(w[3:14]), " ".join(order), " ".join(w[2:8] + ["a", "b", "c"] + w[8:14]), SHORT[:-18], None, "", "  "]
    assert pairs(spark, texts) == [(0, 100), (1, 100), (2, 100)]


def test_brute_force_over_random_texts(spark):
    """Alignment of whole texts, without filter, must find the same pairs."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(60)]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.choice([5, 9, 14, 30, 60]))) for _ in range(25)]
    texts = []
    for _ in range(240):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 25))]
        src = r.choice(items).split()
        a = r.randrange(len(src))
        part = src[a : a + r.choice([6, 10, 12, 16, 30])]
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randrange(len(part))
            part[k : k + 1] = r.choice([[], [r.choice(vocabulary)], [part[k], "zzz"], [part[k][::-1]]])
            part = part or ["q"]
        texts.append(" ".join(w[:10] + part + w[10:]))
    want = []
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            a = leakage.words_of(item)
            if leakage.matches(a, leakage.words_of(t)):
                want.append((i, 100 + k))
    assert len(want) > 30
    assert pairs(spark, texts, items) == sorted(want)
    assert pairs(spark, texts, items, block_chars=200) == sorted(want)


def test_tiny_items_long_texts_and_empty_tables(spark):
    long = "word " * 60000 + ITEM + " word" * 60000
    assert pairs(spark, [long, "so yes no maybe", "yes so no"], (ITEM, "yes no", None, "")) == [(0, 100), (1, 101)]
    assert pairs(spark, [], (ITEM,)) == [] and pairs(spark, [ITEM], ()) == []


def test_long_texts_are_searched_in_windows(spark):
    w = [f"x{i}" for i in range(60_500)]
    for at in (0, 19_790, 39_795, 60_480):
        text = w[:at] + ITEM.split()[:14] + w[at:]
        assert pairs(spark, [" ".join(text)], (ITEM,)) == [(0, 100)]


def test_words_before_the_first_shared_gram_are_seen(spark):
    item = "it is in a blue wooden cabin standing beside quiet mountain water where seven herons wait for the evening boat"
    assert pairs(spark, ["it is in a green wooden cabin standing beside quiet mountain water"], (item,)) == [(0, 100)]


def test_changed_ends(spark):
    w = "nine copper kettles waited beside the narrow window until midnight came quietly".split()
    assert len(w) == 12
    texts = [" ".join(w[:11] + ["quietley"]), " ".join(["mine"] + w[1:]), " ".join(w[:11] + ["loudly"]), " ".join(w[:10] + ["x", "y"])]
    assert pairs(spark, texts, (" ".join(w),)) == [(0, 100), (1, 100), (2, 100)]
    # of a longer item eleven words are no case, unless the twelfth is misspelt
    long = w + "and nobody dared to open that heavy wooden door again before spring".split()
    texts = [" ".join(w[:11] + ["quietley"]), " ".join(w[:11] + ["loudly"]), " ".join(w[:11])]
    assert pairs(spark, texts, (" ".join(long),)) == [(0, 100)]
    # three changes in 24 words, none of whose shorter stretches qualifies
    w24 = (long + ["extra"])[:24]
    part = [x if i not in (8, 11, 12) else "zzz" for i, x in enumerate(w24)]
    assert pairs(spark, [" ".join(part)], (" ".join(w24 + w24[::-1]),)) == [(0, 100)]


def test_filter_loses_nothing():
    """Short words, another script, changes anywhere: the filtered search finds what aligning whole texts finds."""
    r = random.Random(11)
    latin = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.choice([1, 2, 2, 3, 3, 4, 5, 8, 14]))) for _ in range(300)]
    hindi = ["".join(r.choice("कखगघचछजझटठडढतथदधनपफबभमयरलवशसह") for _ in range(r.choice([1, 2, 2, 3, 4, 6]))) for _ in range(200)]
    found = 0
    for vocabulary in (latin, hindi, latin + hindi) * 2:
        items = [[r.choice(vocabulary) for _ in range(r.choice([1, 2, 4, 8, 9, 11, 12, 13, 15, 18, 24, 25, 30, 60]))] for _ in range(20)]
        index = leakage.Index([(i, " ".join(w)) for i, w in enumerate(items)])
        docs = []
        for k, item in enumerate(items):
            for _ in range(5):
                a = r.randrange(max(len(item) - 11, 1))
                part = item[a : a + r.choice([12, 12, 13, 16, 20, 24, 25, 30])]
                for _ in range(r.choice([0, 1, 1, 2, 2, 3])):
                    if part:
                        j = r.choice([0, len(part) - 1, r.randrange(len(part))])
                        w = part[j]
                        part[j : j + 1] = r.choice([[], [r.choice(vocabulary)], [w, "z" * r.choice([2, 9, 38])], [w[:-1] + "q"], [w[:1] + w[2:] or w], ["q" + w]])
                around = lambda: [r.choice(vocabulary) for _ in range(r.choice([0, 5, 20]))]
                docs.append((k, around() + part + around()))
        got = {(x[0], x[1]) for x in leakage._search(index, docs)}
        for i, (k, w) in enumerate(docs):
            want = leakage.matches(items[k], w) is not None
            found += want
            assert want == ((i, k) in got), (items[k], w)
    assert found > 200


def test_many_texts_at_once_split_as_one_by_one():
    texts = ["", "a_b _ c", "Caf\u00e9 &amp; <b>x</b>y <br> z-\n> w", "plain - text", "odd \x03 mark", "1 < 2 and", "3 > 2", ITEM, "ques-\ntioned"]
    assert leakage.words_of_many(texts) == [leakage.words_of(t) for t in texts]


# mixing


def test_mix_meets_its_shares(spark):
    r = random.Random(6)
    words = {"a": ["sea", "ship", "sail"], "b": ["corn", "barn", "plough"], "c": ["code", "loop", "type"], "z": ["misc"]}
    rows = []
    for i in range(1500):
        s = r.choice(["a"] * 6 + ["b"] * 2 + ["c"] + ["z"])
        rows.append((i, s, " ".join(r.choice(words[s] + ["the", "and"]) for _ in range(r.randint(0, 60))), 9))
    rows += [(5000, None, "ship ship", 1), (5001, "a", None, 1), (5001, "a", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.3, 4), ("absent", 0.1, 4)], "source string, target_share double, max_repeats int")
    uses, about = mixing.mix(docs, targets, steps=4)
    got = uses.collect()
    assert len(got) == len(rows) and about["accuracy"] > 0.9
    caps = {"a": 1, "b": 2, "c": 4, "z": 0, None: 0}
    assert all(0 <= x["uses"] <= caps[x["source"]] for x in got)
    share = {x["source"]: x["actual_share"] for x in mixing.shares(uses, targets, about["tokenizer"]).collect()}
    assert share["absent"] == 0 and all(abs(share[s] - 1 / 3) < 0.003 for s in "abc")


def test_the_soft_fit_alone(spark):
    """Where the words tell the sources apart, expected shares meet the targets."""
    r = random.Random(8)
    words = {"a": ["sea", "ship", "sail"], "b": ["corn", "barn", "plough"]}
    rows = [(i, s, " ".join(r.choice(words[s]) for _ in range(r.randint(5, 30)))) for i, s in enumerate(r.choices("ab", (5, 2), k=900))]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    uses, about = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), targets, soft_only=True)
    got = {x["source"]: x for x in mixing.expected(uses, targets, about).collect()}
    assert all(abs(x["expected_share"] - 0.5) < 0.02 and x["most_uses"] <= x["max_repeats"] for x in got.values()) and about["objective"][-1] < 1e-3


def test_cells_follow_the_sources_not_the_documents():
    assert mixing.levels_of(8) == 8 and mixing.levels_of(200) < 8
    p = np.random.default_rng(1).dirichlet(np.ones(8), 50_000)
    assert np.unique(mixing.cells_of(p, 8)).size <= 7000
    w, n = mixing.features(["b a a", "", "c", "\x03"])
    assert n.tolist() == [2, 0, 1, 0] and w.size == 3


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    uses, _ = mixing.mix(docs, targets)
    assert uses.count() == 0
    assert mixing.shares(uses, targets, "t").first()["actual_share"] == 0


@given(st.lists(st.tuples(st.floats(0, 4), st.integers(0, 500)), max_size=50))
@settings(max_examples=50, deadline=None)
def test_diffusion_stays_within_the_rates(rows):
    rows.sort(key=lambda x: -x[1])
    rate, tok = np.array([x[0] for x in rows]), np.array([float(x[1]) for x in rows])
    uses, _ = mixing.diffuse(rate, tok, 0.0)
    assert ((uses >= np.floor(rate)) & (uses <= np.ceil(rate + 1e-9))).all()
    assert abs((uses * tok).sum() - (rate * tok).sum()) <= max(tok, default=0) / 2 + 1e-6


# keyword stuffing

STUFFED = [
    "buy rain gauge cheap rain gauge best rain gauge rain gauge online rain gauge sale rain gauge shop rain gauge deal",
    "umbrella for the rain / umbrella with the best price / umbrella for women and kids / umbrella from our shop / best umbrella for you / umbrella in the garden",
    "https://a.test/x http://www.b.example/y?ref=3 c.invalid/go d.test/z.html https://e.test",
    "#rain #gauge #sale #umbrella #new2024 #kids #travel #brass #mini #solar",
    '<a href="http://a.test/1">buy hose</a><a href="http://a.test/2">cheap hose</a><a href="b.test/3">hose sale</a><a href="b.test/4">best hose</a>',
    "RX-12 • 18 cm • outdoor • UM-13 • rain gauge • garden • 46 cm • hose • premium • WS-741 • sun hat • digital • 9 cm",
    "Regenmesser günstig Regenmesser kaufen Regenmesser Angebot Regenmesser Test Schirm billig Schirm Rabatt Schirm online Schirm",
    "We love it. " + "sale barometer, cheap barometer, buy barometer, best barometer, " * 5,
]
HONEST = [
    "I ordered the green version for use in the shed and it has survived every storm. For the price you won't find a better one.",
    "I love this rain gauge. The best rain gauge we ever had. A rain gauge should be like this rain gauge. My mum wants this rain gauge too.",
    "It works. See https://a.test/x for the manual, which says the same as the box. We keep it by the back door. #brass #mini",
    "ok", "Super", "", None, "Five stars", "https is what I use, and it is fine for me, so I would not change it at all.",
    "Es steht in der Küche und hat jedes Wetter überstanden. Die Montage dauerte nur 2 Minuten, und alles wirkt stabil.\n+ leise\n+ stabil\n- laut",
    "El envío tardó 10 días y llegó bien embalado. Montarlo me llevó 8 minutos. Lo tenemos en el balcón y aguanta cualquier tormenta.",
    "मैं इसे दो हफ़्ते से इस्तेमाल कर रहा हूँ और बहुत ख़ुश हूँ। इस दाम में यह बढ़िया है। मेरी बहन को भी यह पसंद आया।",
]


#: Honest reviews in languages of which there are no others.
ELSEWHERE = [
    "Купила этот дождемер для дачи в прошлом месяце и очень довольна. Он стоит в саду уже три недели, пережил две грозы и сильный ветер. Показания совпадают с тем, что передают по радио. Крепление удобное, шкала читается легко.",
    "Kupiłam ten deszczomierz do ogrodu w zeszłym miesiącu i jestem bardzo zadowolona. Stoi na tarasie od trzech tygodni, przetrwał dwie burze i silny wiatr. Wskazania zgadzają się z tym, co podają w radiu.",
    "Ho comprato questo pluviometro per il giardino il mese scorso e sono molto contento. Sta sul balcone da tre settimane, ha resistito a due temporali e a un vento forte. Le misure concordano con quelle della radio.",
    "Bu yağmur ölçeri geçen ay bahçe için aldım ve çok memnunum. Üç haftadır balkonda duruyor, iki fırtınaya ve kuvvetli rüzgâra dayandı. Ölçümler radyoda söylenenlerle uyuşuyor. Montajı kolay.",
    "先月、庭のためにこの雨量計を買いました。とても満足しています。ベランダに三週間置いていますが、二度の嵐と強い風にも耐えました。数値はラジオの発表と一致します。取り付けは簡単で、目盛りも読みやすいです。",
]
#: Stuffing there needs other evidence.
ELSEWHERE_STUFFED = ["купить дождемер, дешево дождемер, дождемер цена, дождемер недорого, дождемер магазин, дождемер отзывы, " * 4]
CORPUS = "/root/testdata/sf0.1/documents.parquet"


@pytest.mark.skipif(not __import__("os").path.exists(CORPUS), reason="no test tables")
def test_stuffing(spark):
    texts = [*STUFFED, *ELSEWHERE_STUFFED, *HONEST, *ELSEWHERE]
    few = len(STUFFED) + len(ELSEWHERE_STUFFED)
    rows = [(10**9 + i, t, "zz", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, words int")
    corpus = spark.read.parquet(CORPUS).select("doc_id", "text", "lang").withColumn("words", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = stuffing.stuffed(corpus.unionByName(df).unionByName(df)).where(f"doc_id >= {10**9}").collect()
    assert len(got) == 2 * len(texts)
    # the praise of few other words is at the limit where so few texts are learnt from
    assert {r["doc_id"] - 10**9 for r in got if r["found"]} - {few + 1} == set(range(few))
    assert {r["language"] for r in got if r["doc_id"] - 10**9 >= len(texts) - len(ELSEWHERE)} == {""}
    assert stuffing.stuffed(df.limit(0)).count() == 0
    # without any language learnt only links, repeats and lists are evidence
    alone = {r["doc_id"] - 10**9 for r in stuffing.stuffed(df.drop("lang")).where("found").collect()}
    assert {2, 3, 4} <= alone <= set(range(few))


def test_texts_are_split_together_as_one_by_one():
    texts = [*STUFFED, *HONEST, "a\x01b \x03 c <a href='x'>one two</a> [three](http://x.test/y)", "x " * 50_000]
    t = stuffing.split(texts)
    for i, text in enumerate(texts):
        own = stuffing.split([text])
        assert own.w.tolist() == t.w[t.starts[i] : t.ends[i]].tolist() and own.marks.tolist() == t.marks[t.starts[i] : t.ends[i]].tolist()
    assert stuffing.split([]).w.size == 0 and stuffing.split([None, ""]).n.tolist() == [0, 0]


def test_measures_by_hand():
    t = stuffing.split(["red hat red hat red hat", "One. Two. One. Three.", "https://a.test #x y z", "aa, bb, cc, dd, ee, ff"])
    stuffing.mark(t)
    m = stuffing.measures(t, stuffing._top(t, np.ones(t.w.size, bool)), stuffing._duplicate_lines(t))
    assert m["top_word_share"].tolist() == [0.5, 0.5, 0.25, 1 / 6] and m["ngram_share"].tolist()[0] == 1.0
    assert m["duplicate_line_share"].tolist() == [0, 0.25, 0, 0] and m["link_share"][2] == 0.5
    assert m["separator_density"][3] == pytest.approx(5 / 6) and stuffing.list_items(t).tolist() == [False] * 14 + [True] * 6
    assert stuffing.density(np.array([True] * 3 + [False] * 17), stuffing.split(["a " * 20])).tolist()[0] == pytest.approx(3 / 9)


def test_disguised_words_are_one_word():
    t = stuffing.split(["d3humidifi3r dehumidifier w3@th3r weather UM-241 2024 33"])
    assert t.w[0] == t.w[1] and t.w[2] == t.w[3] and len(set(t.w.tolist())) == 5
