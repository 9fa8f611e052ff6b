"""Quality rules, quality and toxicity classifiers and the language model."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import labelled, language_model, quality_model, quality_rules, toxicity

from .common import frame, prose, rng

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    runs = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = [False] * len(w)
    for k in range(len(w) - 2):
        if runs[w[k], w[k + 1], w[k + 2]] > 1:
            inside[k] = inside[k + 1] = inside[k + 2] = True
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n, repeat = len(w), sum(inside)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, repeat, n < 50 or 100 * repeat > 50 * n


def sentences(r, n):
    return " ".join(f"{prose(r, 9).capitalize()}." for _ in range(n))


def test_base_figures(spark):
    r = rng(6)
    texts = [None, "", " \n\t ", "a", "a\n\na\r\n a\na", "x y z x y z", "# * é $| <>", "ü" * 3000, "a b c " * 40, sentences(r, 30), "\n".join(["same line."] * 5), prose(r, 6000), "a\x1cb\x85c d"]
    got = {x["doc_id"]: x for x in quality_rules.clean_lines(frame(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        x = got[k]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == base(t), t


def test_lines_and_verdicts(spark):
    r = rng(7)
    good = "\n".join(sentences(r, 4) for _ in range(5))
    texts = [
        good, good + "\nHome | About | Contact | Help | Terms", " | ".join(prose(r, 1) for _ in range(80)), "\n".join(" ".join(w + "&&&" for w in prose(r, 20).split()) for _ in range(5)), "\n".join(prose(r, 20).upper() + "!!" for _ in range(5)),
        " ".join(w for w in prose(r, 20).split() for _ in range(5)), good + "\nAll Rights Reserved by the site. " + "x " * 5, "short. text",
    ]
    got = {x["doc_id"]: x for x in quality_rules.clean_lines(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[k]["kept"] for k in range(8)] == [True, True, False, False, False, False, True, False]
    assert got[0]["clean_text"] == good == got[1]["clean_text"] == got[6]["clean_text"] and got[1]["n_failed_lines"] == 1 and got[1]["lost_words"] == 9
    odd = quality_rules.clean_lines(frame(spark, [(None, "a.", 1), (2, "b.", 1), (2, "b.", 1)], "doc_id long, text string, kept int"))
    assert odd.count() == 3 and quality_rules.clean_lines(frame(spark, [])).count() == 0


def accuracy(rows, truth, held_out):
    own = [r for r in rows if r["held_out"] == held_out]
    return sum(r["predicted"] == truth[r["doc_id"]] for r in own) / len(own)


def labelled_corpus():
    r = rng(12)
    rows, labels = [], []
    for k in range(400):
        text, toxic, good = sentences(r, 12), k % 4 == 0, k % 3 != 0
        if toxic:
            text = text.replace(".", f" you {r.choice(['grobnik', 'grobnak', 'grobling'])}.", 2)
        if not good:
            text = " ".join(w + "###" if n % 2 else w for n, w in enumerate(text.split()))
        rows.append((k, text))
        labels.append((k, int(good), int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "some text"), (5, rows[5][1]), (1002, prose(r, 8000))]
    labels += [(None, 1, 1), (2000, 1, 1), (7, None, None)]
    return rows, labels


@pytest.mark.parametrize("module,column", [(quality_model, 1), (toxicity, 2)])
def test_classifiers_on_the_held_out_fold(spark, module, column):
    rows, labels = labelled_corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string")
    got = module.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {r[0]: r[column] for r in labels if r[0] is not None and r[0] < 400}
    truth[7] = 1 if column == 1 else 0
    own = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert accuracy(own, truth, True) > 0.95 and accuracy(own, truth, False) > 0.95
    for r in got:
        assert r["held_out"] == (None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    # Labels of the held-out fold have no part: other values there give the same scores.
    other = [(i, 1 - q if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5 == 0 else q, 1 - t if i is not None and t is not None and zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    again = module.classify(docs, spark.createDataFrame(other, "doc_id long, quality int, toxic int")).collect()
    assert {(r["doc_id"], round(r["score"], 9)) for r in again} == {(r["doc_id"], round(r["score"], 9)) for r in got}


def test_classifiers_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, "a b"), (2, None)])
    assert [r["score"] for r in quality_model.classify(docs, none).collect()] == [0.5, 0.5]
    assert [r["predicted"] for r in toxicity.classify(docs, none).collect()] == [0, 0]
    assert toxicity.classify(docs.limit(0), none).count() == 0 == quality_model.classify(docs.limit(0), none).count()


@pytest.mark.parametrize("module", [quality_model, toxicity])
def test_columns_named_as_results_are_ignored(spark, module):
    rows, labels = labelled_corpus()
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = frame(spark, rows)
    named = spark.createDataFrame([("a", True, 7.0, i, t, 3) for i, t in rows], "label string, held_out boolean, score double, doc_id long, text string, quality int")
    one, other = (sorted(map(str, module.classify(docs, labels).collect())) for docs in (plain, named))
    assert one == other and len(one) == len(rows)


def test_sample_is_bounded_and_keeps_the_fold_out(spark):
    rows, labels = labelled_corpus()
    got = labelled.sample(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "toxic", {0: 40, 1: 10})
    assert Counter(r["label"] for r in got.collect()) == {0: 40, 1: 10}  # one doc_id comes twice
    fold = {r["doc_id"]: r["f"] for r in frame(spark, rows).select("doc_id", labelled.fold(F.col("doc_id")).alias("f")).collect()}
    assert all(f == zlib.crc32(str(i).encode()) % 5 for i, f in fold.items() if i is not None)


def figures(*words_):
    """What the grammar finds in one text, with two insults known."""
    h = np.array(sorted(toxicity._word_hash(w) for w in ("fool", "oaf")), np.uint64)
    fixed = {toxicity._word_hash(w): c for c, ws in ((toxicity.THREAT, toxicity.THREATS), (toxicity.TARGET, toxicity.TARGETS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS)) for w in ws}
    fixed |= {toxicity._word_hash(w): toxicity.LONE_THREAT for w in toxicity.LONE_THREATS}
    keys = np.array(sorted([*h.tolist(), *fixed]), np.uint64)
    lexicon = toxicity.Lexicon(keys, np.array([fixed.get(int(k), toxicity.INSULT) for k in keys], np.int8), np.ones(len(keys)), np.zeros(0, np.uint64), np.zeros(0))
    raw = np.frombuffer(" ".join(words_).encode(), np.uint8)
    x = toxicity.figures(raw, np.array([0, len(raw)]), lexicon)[0]
    return dict(zip(toxicity.FIGURES, x, strict=True))


def test_grammar_takes_clauses():
    def categories(text):
        f = figures(text)
        return {c for c in toxicity.CATEGORIES if f[f"log_{c}"] > 0}

    assert categories("what an oaf") == {"plain"}
    assert categories("you are an oaf") == {"aimed"}
    assert categories("this is not an oaf") == {"negated"}
    assert categories("not here. an oaf") == {"plain"}  # another clause
    assert categories("not in any of the many places with an oaf") == {"plain"}  # out of reach
    assert categories("she said that this is a fool") == {"reported"}
    assert categories("they will kill") == {"threat"} and categories("never kill them") == set()
    assert categories("") == set() and categories("said you not") == set()
    assert figures("an oaf, a fool. an oaf")["matches"] == pytest.approx(math.log1p(3))


def test_threats_before_their_target(spark):
    def categories(text):
        f = figures(text)
        return {c for c in toxicity.CATEGORIES if f[f"log_{c}"] > 0}

    assert categories("i will kill you") == categories("we will hurt them") == categories("kill and destroy all of you") == {"threat"}
    assert categories("i will not kill you") == categories("she said kill them") == categories("kill time. you") == categories("i kill no one of them") == set()
    assert categories("kill some time in one of the many parks with you") == set()  # out of reach
    assert figures("they will kill you and your")["matches"] == figures("i will kill you and your")["matches"] == pytest.approx(math.log1p(1))
    # A learned weight stands beside the threat; "die" takes no object.
    rows = [(1, f"w{k} kill die") for k in range(20)] + [(0, f"v{k} fine") for k in range(20)]
    lexicon, _ = toxicity.learn_lexicon(spark.createDataFrame(rows, "label int, text string"))

    def learned(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return dict(zip(toxicity.FIGURES, toxicity.figures(raw, np.array([0, len(raw)]), lexicon)[0], strict=True))

    assert learned("kill")["log_plain"] > math.log1p(2) and learned("die for you")["log_threat"] == 0
    assert learned("kill you")["log_threat"] > math.log1p(3) and learned("kill you")["log_plain"] == 0
    none, _ = toxicity.learn_lexicon(spark.createDataFrame(rows[:20], "label int, text string"))
    lexicon = none
    assert learned("die for you")["matches"] == 0 and learned("you die")["log_threat"] == pytest.approx(math.log1p(3))


def interpreted(text):
    """The figures of one text, read word by word; weights are those of ``figures`` above."""
    lists = {"threat": toxicity.THREATS, "target": toxicity.TARGETS, "negation": toxicity.NEGATIONS, "report": toxicity.REPORTS, "insult": ["fool", "oaf"]}
    sums, best, matched, clauses, total, place = dict.fromkeys(toxicity.CATEGORIES, 0), 0.0, 0, 0, 0, 0
    for clause in re.split(r'[.,;:!?()"\n]', text):
        negated = reported = aimed = False
        pending = last = None
        found = []
        words_ = re.findall(r"[0-9a-z'\x80-\U0010ffff]+", clause)
        for w in words_:
            place += 1
            kind = next((k for k, own in lists.items() if w in own), None)
            if kind is None:
                continue
            if last is not None and place - last > toxicity.SCOPE:
                negated, aimed, pending = False, False, None
            last = place
            asserted = not negated and not reported
            if kind == "negation":
                negated = True
            elif kind == "report":
                reported = True
            elif kind == "target":
                if pending and asserted:
                    found.append("threat")
                aimed, pending = True, None
            elif kind == "insult":
                found.append("reported" if reported else "negated" if negated else "aimed" if aimed else "plain")
            else:
                if aimed and asserted:
                    found.append("threat")
                if w not in toxicity.LONE_THREATS:
                    pending = asserted and not aimed
        for c in found:
            sums[c] += 1
        total, clauses, matched = total + len(found), clauses + bool(words_), matched + bool(found)
        best = max(best, sum(0.5 if c in ("negated", "reported") else 1.0 for c in found))
    return [*(math.log1p(sums[c]) for c in toxicity.CATEGORIES), best, math.sqrt(matched / max(clauses, 1)), math.log1p(total)]


def test_figures_word_by_word():
    r = rng(31)
    pool = ["fool", "oaf", "kill", "die", "you", "them", "not", "said", "a", "the", "of", "word", "other", "more"]
    for _ in range(400):
        text = " ".join(r.choice(pool) + r.choice(["", "", "", "", "", ",", ".", "!\n"]) for _ in range(r.randrange(1, 60)))
        assert list(figures(text).values()) == pytest.approx(interpreted(text)), text


def test_clauses_tell_more_than_words(spark):
    r = rng(32)
    rows, labels = [], []
    for k in range(600):
        toxic, mention = k % 3 == 0, k % 15 == 1
        said = r.choice(["you are a grobnik", "you grobnik"]) if toxic else r.choice(["she said that he is a grobnik", "this is not a grobnik"]) if mention else prose(r, 5)
        rows.append((k, f"{sentences(r, 3)} {said}. {sentences(r, 2)}"))
        labels.append((k, 1, int(toxic)))
    got = {x["doc_id"]: x for x in toxicity.classify(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    mentions = [got[k]["predicted"] for k in range(600) if k % 15 == 1]
    assert sum(mentions) <= 0.1 * len(mentions)  # the same word, negated or reported
    assert all(got[k]["predicted"] for k in range(0, 600, 3)) and not any(got[k]["predicted"] for k in range(600) if k % 3 and k % 15 != 1)


def _auc(scores, labels):
    """The share of pairs of a toxic and a clean text that are in order; ties count half."""
    order = sorted(zip(scores, labels, strict=True))
    above = ties = 0
    for value, group in itertools.groupby(order, key=lambda x: x[0]):
        own = [y for _, y in group]
        ties += sum(own) * (len(own) - sum(own))
        above += sum(own) * sum(1 for v, y in order if v < value and not y)
    toxic = sum(labels)
    return (above + ties / 2) / (toxic * (len(labels) - toxic))


def test_grammar_tells_more_than_a_bag_of_its_words(spark):
    """Held out, with mentions, reports, negations and inflected threats: the same words on both sides."""
    r, rows, labels = rng(41), [], []
    for k in range(900):
        toxic, mention = k % 3 == 0, k % 3 == 1 and k % 2 == 0
        word, verb = r.choice(["grobnik", "snarfle", "blivet"]), r.choice(["kill", "be killing", "murder", "stab"])
        asserted = [f"you are a {word}", f"such a {word} you are", f"they will {verb} you", f"we {verb} them"]
        told = [f"she said you are a {word}", f"you are not a {word}", f"he wrote that nobody is a {word}", f"he reported that they {verb} you", f"they never {verb} you"]
        said = r.choice(asserted) if toxic else r.choice(told) if mention else prose(r, 6)
        rows.append((k, f"{sentences(r, 3)} {said}. {sentences(r, 2)}"))
        labels.append((k, 1, int(toxic)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    held = [x for x in toxicity.classify(docs, marks).collect() if x["held_out"]]
    assert len(held) > 120

    def bag(text):
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        start, end, _, h = toxicity._words(raw, np.array([0, len(raw)]))
        weight = np.zeros(len(h))
        for long, short in toxicity._beginnings(raw, start, end):
            found, at = toxicity._find(model.lexicon.beginning, short, model.lexicon.seen_beginning)
            weight[long[found]] = model.lexicon.odds[at]
        found, at = toxicity._find(model.lexicon.whole, h, model.lexicon.seen_whole)
        weight[found] = np.where(np.isin(model.lexicon.kind[at], (toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT)), 0, model.lexicon.weight[at])
        return weight.sum()

    texts, toxic = dict(rows), {k: t for k, _, t in labels}
    y = [toxic[x["doc_id"]] for x in held]
    grammar, words = _auc([x["score"] for x in held], y), _auc([bag(texts[x["doc_id"]]) for x in held], y)
    print(f"held-out AUC: grammar {grammar:.3f}, bag of its words {words:.3f}")
    assert grammar > 0.95 and grammar > words + 0.05


def test_inflected_threats():
    for said in ("they are killing you", "he murdered them", "ich töte dich", "je vais détruire vous", "ellos matarán"):
        assert "threat" in {c for c in toxicity.CATEGORIES if figures(said)[f"log_{c}"] > 0}, said


def test_articles_are_no_threats(spark):
    german = ["siehst du die sonne", "hast du die post geholt", "du und die anderen"]
    rows = [(0, f"{german[k % 3]} {k}.") for k in range(60)] + [(1, f"you grobnik {k}. they will kill you") for k in range(30)]
    lexicon, _ = toxicity.learn_lexicon(spark.createDataFrame(rows, "label int, text string"))
    for text in german:
        raw = np.frombuffer(text.encode(), np.uint8)
        assert not toxicity.figures(raw, np.array([0, len(raw)]), lexicon).any()


def test_unigram_figures_and_held_out_gain(spark, monkeypatch):
    r = rng(21)
    langs = [[f"{a}{b}" for a in p for b in ("ra", "lo", "mi", "ta", "ne")] for p in (("ka", "ku", "ke", "ki"), ("zo", "zu", "za", "ze"))]
    rows = [(k, " ".join(r.choice(langs[k % 2]).capitalize() for _ in range(r.randrange(20, 120)))) for k in range(300)]
    rows += [(900, None), (901, ""), (None, "Kara"), (902, "unseen words Only"), (902, "unseen words Only"), (903, "zora " * 5000)]
    monkeypatch.setattr(language_model, "TOP_TOKENS", 25)
    got = language_model.score(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3)).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, [*WORD.findall((t or "").translate(lower)), None]) for i, t in rows]
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows if i is not None}
    c = Counter(w for i, ws in tokens if i is not None and fold[i] != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, None if i is None else fold[i] == 1, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
    assert Counter((x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got) == want
    held = [x for x in got if x["held_out"] and x["doc_id"] < 300]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held) and all(x["score"] <= 1e-6 for x in got)
    assert language_model.score(frame(spark, [])).count() == 0


def test_class_factor_is_a_distribution():
    r = np.random.default_rng(2)
    weights = r.normal(size=(language_model.ROWS, language_model.CLASSES)).astype(np.float32)
    rows, _ = language_model.contexts(r.integers(0, 1 << 60, 50).astype(np.uint64), r.integers(0, language_model.CLASSES, 50), np.array([0, 20, 20 + 30]))
    each = [np.exp(language_model.log_softmax(weights, rows, np.full(50, c))) for c in range(language_model.CLASSES)]
    assert np.allclose(sum(each), 1, atol=1e-4)
    far = np.exp(language_model.log_softmax(weights * 1000, rows, np.zeros(50, int)))
    assert np.isfinite(far).all()
    assert rows.min() >= 0 and rows.max() < language_model.ROWS


@pytest.mark.parametrize("top,shard,hot", [(1 << 17, 1 << 22, 1.0), (60, 64, 0.002)])
def test_scores_word_by_word(spark, monkeypatch, top, shard, hot):
    monkeypatch.setattr(language_model, "TOP_TOKENS", top)
    monkeypatch.setattr(language_model, "SHARD_TOKENS", shard)
    monkeypatch.setattr(language_model, "HOT_SHARE", hot)
    monkeypatch.setattr(language_model, "HELD_KEYS", 500)
    r = rng(3)
    passage = prose(r, 40)
    rows = [(k, f"{prose(r, 15)} {passage if k % 3 == 0 else prose(r, 40)}. {'of course ' * (k % 5)}" + prose(r, 3)) for k in range(60)]
    rows += [(None, passage), (70, None), (71, rows[0][1]), (71, rows[0][1]), (72, "never seen"), (73, passage * 30)]
    docs = frame(spark, rows).repartition(3)
    model = language_model.train(docs)
    words, table = model.words, {}
    for x in model.ngrams.collect():
        table |= dict(zip(np.frombuffer(bytes(x["keys"]), np.uint64).tolist(), np.frombuffer(bytes(x["about"]), np.float32).tolist(), strict=True))
    assert len(table) > 50 and (len(model.hot) > 0) == (hot < 1)
    counts = {x["token"]: x["c"] for x in model.counts.collect()}

    def parts(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        h, kind, bounds = language_model.tokenize(raw, np.array([0, len(raw)]))
        at = words.find(h)
        kind = words.classes(at, kind)
        features, both = language_model.contexts(h, kind, bounds)
        return h, at, kind, features, list(zip(language_model.skip_contexts(words, h, at, bounds), both, strict=True))

    def in_class(context, kind, at, c):
        """The probability of a token of count c in its class."""
        if kind <= language_model.END_CLASS:
            return 1.0
        key = int(language_model.ngram_keys(*(np.array([x]) for x in (*context, kind, at)))[0])
        alone, token = key >> 40 << 40, int(at) + 1
        rest = table.get(key - token, table.get(alone, 0.0))
        factor = table.get(key, rest + (table.get(alone + token, 0.0) if token else 0.0))
        return (c + 0.5) / 10 ** words.class_place[kind] * 10**factor

    got = {(x["doc_id"], x["n_tokens"]): x["score"] for x in language_model.scored(docs, model).collect()}
    assert len(got) == len(rows) - 1
    for i, text in rows:
        h, at, kind, features, both = parts(text)
        want = 0.0
        for k in range(len(h)):
            want += math.log10(in_class(both[k], kind[k], at[k], counts.get(int(h[k].astype(np.int64)), 0)))
        want += language_model.log_softmax(model.weights, features, kind).sum() / math.log(10)
        assert got[i, len(h)] == pytest.approx(want, abs=1e-4)
    # In each class all its tokens and the place of the unknown ones have probability 1 together.
    rest = {c: [] for c in range(language_model.CLASSES)}
    for x in model.counts.collect():
        at = int(words.find(np.array([x["token"]], np.int64).view(np.uint64))[0])
        rest[int(words.kind[at]) if at >= 0 else x["kind"]].append((at, x["c"]))
    _, _, kind, _, both = parts(rows[0][1])
    for k in range(20, 40):
        if kind[k] > language_model.END_CLASS:
            assert sum(in_class(both[k], kind[k], at, c) for at, c in [*rest[int(kind[k])], (-1, 0)]) == pytest.approx(1, abs=1e-5)


def _counts_in_classes(r, contexts=60, tokens=40):
    """A vocabulary of one class, and counted n-grams whose tokens depend on the skip and on the n-gram."""
    kind = language_model.END_CLASS + 3
    names = np.sort(r.integers(1, 1 << 62, tokens).astype(np.uint64))
    at, skip, both = [], [], []
    for c in range(contexts):
        for _ in range(r.integers(1, 80)):
            at.append(r.choice([-1, r.integers(tokens), (c % 4) * 7 + r.integers(4), c % tokens]))
            skip.append(np.uint64((c % 4 + 1) << 50))
            both.append(np.uint64(c + 1))
    at = np.array(at)
    n = np.bincount(at[at >= 0], minlength=tokens) + 1
    place = np.zeros(language_model.CLASSES)
    place[kind] = math.log10(n.sum() + 5 + 0.5 * (tokens + 4))
    words = language_model.Vocabulary(names, n, np.full(tokens, kind), np.zeros(language_model.CLASSES), place, int(n.sum()), tokens)
    return words, *np.unique(language_model.ngram_keys(np.array(skip), np.array(both), np.full(len(at), kind), at), return_counts=True)


def _likelihood(model, keys, counts, skip_w, gram_w):
    """The penalised log likelihood of all counted tokens, token by token; unknown and other tokens have the rest of the class."""
    of_skip = {int(k): i for i, k in enumerate(model.skip)}
    of_gram = {int(k): i for i, k in enumerate(model.gram)}
    shares = {int(k) & 0x3FFFF: float(q) for k, q in [*zip(model.gram, model.gram_q, strict=True), *zip(model.skip, model.skip_q, strict=True)]}
    total = -language_model.PENALTY * (skip_w.sum() + gram_w.sum())
    for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
        def weight(token, key=key):
            i, j = of_skip.get(key >> 40 << 40 | token), of_gram.get(key >> 18 << 18 | token)
            return (0.0 if i is None else skip_w[i]) + (0.0 if j is None else gram_w[j])
        total += n * (weight(key & 0x3FFFF) - math.log(1 + sum(q * math.expm1(weight(t)) for t, q in shares.items())))
    return total


def test_weights_in_classes_follow_the_gradient():
    r = np.random.default_rng(5)
    words, keys, counts = _counts_in_classes(r)
    model = language_model.InClass(words, keys, counts)
    assert len(model.skip) > 4 and len(model.gram) > 10 and (model.gram_skip < len(model.skip)).any()
    skip, gram, _, _ = model.gradients()
    eps = 1e-5
    for k in range(0, len(model.skip), 3):
        moved = np.eye(len(model.skip))[k] * eps
        slope = (_likelihood(model, keys, counts, model.skip_w + moved, model.gram_w) - _likelihood(model, keys, counts, model.skip_w - moved, model.gram_w)) / (2 * eps)
        assert skip[k] == pytest.approx(slope, abs=1e-3)
    for k in range(0, len(model.gram), 7):
        moved = np.eye(len(model.gram))[k] * eps
        slope = (_likelihood(model, keys, counts, model.skip_w, model.gram_w + moved) - _likelihood(model, keys, counts, model.skip_w, model.gram_w - moved)) / (2 * eps)
        assert gram[k] == pytest.approx(slope, abs=1e-3)
    before = [_likelihood(model, keys, counts, model.skip_w, model.gram_w)]
    for _ in range(language_model.STEPS):
        model.step()
        before.append(_likelihood(model, keys, counts, model.skip_w, model.gram_w))
    assert all(b >= a - 1e-9 for a, b in zip(before, before[1:], strict=False)) and before[-1] > before[0] + 1
    for _ in range(300):
        model.step()
    skip, gram, _, _ = model.gradients()
    assert max(np.abs(skip).max(), np.abs(gram).max()) < 0.05


def test_skips_reach_the_token_in_its_class(spark):
    """The word two before tells which of two alike words follows; the word between is new each time."""
    r = rng(31)

    def text():
        out = []
        for _ in range(40):
            k = r.randrange(2)
            out += [("zzaro", "zzbro")[k], f"w{r.randrange(10**9)}x", ("qdorn", "qforn")[k], f"v{r.randrange(10**9)}y"]
        return " ".join(out)

    rows = [(k, text() + " " + " ".join(f"t{j}" for j in range(15) for _ in range(60))) for k in range(60)]
    with_skips = {x["doc_id"]: x["score"] for x in language_model.score(frame(spark, rows)).collect()}
    model = language_model.train(frame(spark, rows))
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 1]
    raw = np.frombuffer(rows[held[0]][1].encode(), np.uint8)
    h, kind, bounds = language_model.tokenize(raw, np.array([0, len(raw)]))
    at = model.words.find(h)
    kind = model.words.classes(at, kind)
    assert kind[2] > language_model.END_CLASS
    table = {}
    for x in model.ngrams.collect():
        table |= dict(zip(np.frombuffer(bytes(x["keys"]), np.uint64).tolist(), np.frombuffer(bytes(x["about"]), np.float32).tolist(), strict=True))
    _, both = language_model.contexts(h, kind, bounds)
    keys = language_model.ngram_keys(language_model.skip_contexts(model.words, h, at, bounds), both, np.maximum(kind, language_model.END_CLASS + 1), at)
    gain = [table.get(k >> 40 << 40, 0.0) + table.get(k >> 40 << 40 | k & 0x3FFFF, 0.0) for k in keys[2:160:4].tolist()]
    assert min(gain) > 0.1 and all(math.isfinite(x) for x in with_skips.values())


def test_frequent_words_are_several_skip_contexts(monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 100)
    h = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 500).astype(np.uint64))
    count = np.full(500, 90)
    count[7] = 3000
    words = language_model.Vocabulary(h, count, np.full(500, 20), np.zeros(language_model.CLASSES), np.zeros(language_model.CLASSES), 1, 1)
    text = np.concatenate([[h[7], x, h[9], y, h[11]] for x, y in zip(h[100:300], h[300:], strict=True)])
    got = language_model.skip_contexts(words, text, words.find(text), np.array([0, len(text)]))
    assert 16 < len(set(got[2::5].tolist())) <= 32 and len(set(got[4::5].tolist())) == 1


def test_what_comes_again_is_likelier(spark):
    r = rng(8)
    texts = [prose(r, 60) for _ in range(40)]
    rows = [(k, texts[k]) for k in range(40)] + [(100 + k, texts[k]) for k in range(20)]
    gain = {x["doc_id"]: x["score"] - x["base_score"] for x in language_model.score(frame(spark, rows)).collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    twice = [gain[k] for k in range(20) if fold[k] != 1 and fold[100 + k] != 1]
    once = [gain[k] for k in range(20, 40)]
    assert len(twice) > 5 and min(twice) > max(once) + 10
