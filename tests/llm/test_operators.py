"""The training-data operators on small tables: nulls, empty and repeated rows, ties, clashing names, brute force."""

import collections
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import chat, crowds, decontaminate, katz, language, mixing, neardup, passages, quality, rollup, toxicity
from tracewell.llm.tables import crc_fold, shared_folder

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words_of(text):
    return WORD.findall((text or "").encode().lower())


def prose(rng, n, stock=400):
    return " ".join(f"w{rng.randrange(stock)}x" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, copies, near copies and a passage that several texts share."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 60, 10**6)
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n ", "en", "a", 3), (3, "one", None, "a", 3), (None, "no id here at all", "en", None, 17)]
    for i in range(10, 40):
        w = base.split()
        for k in range(i % 4):
            w[rng.randrange(len(w))] = f"edit{i}n{k}"
        rows.append((i, " ".join(w), "en", "a", None))
    rows += [(i, f"{prose(rng, 30)} {passage} {prose(rng, 20)}\n{prose(rng, 10)}", "de", "b", None) for i in range(50, 56)]
    rows += [(i, prose(rng, 80, 10**6), "de", "b", None) for i in range(60, 70)] + [(70, "x" * 200_000, "de", "b", None)]
    return spark.createDataFrame(rows, DOCS)


def _sets(rows, width):
    out = {}
    for r in rows:
        w = words_of(r.text)
        out[r.doc_id] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return out


def test_near_duplicates_against_brute_force(docs):
    sets = _sets(docs.collect(), 4)
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    named = [i for i in sets if i is not None]
    for a in named:
        for b in named:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in neardup.linked_documents(docs.withColumn("node", F.lit(1))).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), find(i), find(i) == i)
    assert neardup.linked_documents(docs.limit(0)).count() == 0


def test_crowded_buckets_lose_no_link(spark):
    """A chain whose ends share little: everyone is linked with the next one only."""
    rows = [(i, " ".join(f"c{j}" for j in range(i * 3, i * 3 + 60)), "en", "a", None) for i in range(80)]
    got = neardup.linked_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.component_id for r in got} == {0}


def test_crowded_blocks_give_a_forest():
    """Two groups of like sets, each set a root of its own: as few links as join them."""
    near = lambda first: [np.setdiff1d(np.arange(first, first + 40), [first + k]).astype(np.uint64) for k in range(20)]
    group = [{"node": i, "root": i, "elements": e.tobytes()} for i, e in enumerate(near(0) + near(1000))]
    links = list(crowds._joined(group, 80))
    top = list(range(40))
    for a, b in links:
        top = [top[a] if x == top[b] else x for x in top]
    assert len(links) == 38 and len(set(top[:20])) == len(set(top[20:])) == 1 and top[0] != top[20]


def test_filter_and_bands_find_pairs_at_the_threshold():
    """Exact binomial of the registers that agree, for two sets of one size."""
    m, agree = neardup.M, 1 - 2 * float(neardup._share(np.array([0.1]))[0])
    regs = (np.arange(m) >= np.arange(m + 1)[:, None]).astype(np.uint8)
    size = np.full(m + 1, 1000.0)
    dropped = neardup.estimated(regs, np.zeros_like(regs), size, size) < neardup.PERCENT / 100 - neardup.SLACK
    by_filter = sum(math.comb(m, c) * agree**c * (1 - agree) ** (m - c) for c in np.flatnonzero(dropped).tolist())
    by_bands = (1 - agree**neardup.ROWS) ** neardup.BANDS
    assert by_filter < by_bands and by_filter + by_bands < 3e-5


def test_passages_leave_one_copy(docs):
    spans = passages.repeated_spans(docs)
    cut = passages.without_spans(docs, spans)
    assert cut.schema == docs.schema and cut.count() == docs.count()
    windows = collections.defaultdict(set)
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in cut.collect()}
    for i, text in after.items():
        w = words_of(text)
        for k in range(len(w) - 50):
            windows[tuple(w[k:k + 51])].add(i)
    assert not [w for w, ids in windows.items() if len(ids) > 1]
    assert after[50] == before[50] and all(after[i] == before[i] for i in range(60, 71)) and after[0] is None
    assert all(set(words_of(after[i])) <= set(words_of(before[i])) for i in range(51, 56))
    assert passages.repeated_spans(docs.limit(0)).count() == 0


def test_passages_repeated_inside_a_line_go(spark):
    rng = random.Random(8)
    twice, own, apart = (prose(rng, 60, 10**6) for _ in range(3))
    fill = [prose(rng, 30, 10**6) for _ in range(12)]
    rows = [
        (1, f"{fill[0]} {twice} {fill[1]}"), (2, f"{fill[2]} {twice} {fill[3]} {twice} {fill[4]} {twice}"),
        (3, f"{fill[5]} {own} {fill[6]} {own} {fill[7]}"), (4, f"{fill[8]} {apart} {apart} {apart} {fill[9]}"),
        (5, f"{fill[10]} {'again ' * 3000}{fill[11]}"), (6, " ".join(fill))]
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    after = {r.doc_id: words_of(r.text) for r in passages.without_spans(made, passages.repeated_spans(made)).collect()}
    assert after[1] == words_of(rows[0][1]) and after[2] == words_of(" ".join(fill[2:5]))
    assert after[3] == words_of(f"{fill[5]} {own} {fill[6]} {fill[7]}") and after[4] == words_of(f"{fill[8]} {apart} {fill[9]}")
    assert after[5] == words_of(f"{fill[10]} {'again ' * 51}{fill[11]}") and after[6] == words_of(rows[5][1])


def test_short_and_wrapped_paragraphs_go_whole(spark):
    rng = random.Random(9)
    wrap = lambda w: "\n".join(" ".join(w[k:k + 12]) for k in range(0, len(w), 12))
    short, body, title, extra = prose(rng, 25, 10**6), prose(rng, 100, 10**6).split(), prose(rng, 5, 10**6), prose(rng, 60, 10**6)
    near = [w if k != 50 else "edit" for k, w in enumerate(body)]
    own = [prose(rng, 30, 10**6) for _ in range(9)]
    rows = [
        (1, f"{own[0]}\n\n{short}\n\n{wrap(body)}"), (2, f"{own[1]}\n{short}\n{own[2]}"), (3, f"{own[3]}\n \n{wrap(near)}\n\n{own[4]}"),
        (4, " ".join(near)), (5, f"{title}\n{extra}\n\n{own[5]}"), (6, f"{own[6]} {short} {own[7]}"), (7, f"{own[8]}\n\n{extra}")]
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    after = {r.doc_id: words_of(r.text) for r in passages.without_spans(made, passages.repeated_spans(made)).collect()}
    stay = {1: rows[0][1], 2: " ".join(own[1:3]), 3: " ".join(own[3:5]), 4: "", 5: rows[4][1], 6: rows[5][1], 7: own[8]}
    assert after == {i: words_of(text) for i, text in stay.items()}


def test_quality_rules(spark, docs):
    repeats = "a b c d e " * 4 + "f g"
    rows = spark.createDataFrame([(1, repeats, 0), (2, None, 0), (3, "x x x x x x", 0)], "doc_id int, text string, n_words int")
    got = {r.doc_id: r for r in quality.judged(rows).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].base_failed) == (22, 20, True)
    assert (got[2].n_words, got[2].kept) == (0, False) and got[3].n_repeat_words == 6
    assert quality.kept_documents(docs).columns == docs.columns and quality.judged(docs).count() == docs.count()


def test_mixing_is_reproducible_and_meets_its_rates(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit(7).alias("copy"))
    made = mixing.mixed(rows, {"a": 0.6}, passes=3.0)
    counts = {r["source"]: r["count"] for r in made.groupBy("source").count().collect()}
    assert abs(counts["a"] - 7200) < 450 and abs(counts["b"] - 2400) < 260 and abs(counts[None] - 2400) < 260
    key = ["doc_id", "copy", "shuffle_key"]
    assert sorted(map(tuple, made.select(*key).collect())) == sorted(map(tuple, mixing.mixed(rows, {"a": 0.6}, passes=3.0).select(*key).collect()))
    assert mixing.mixed(rows.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", None)], "doc_id int, text string, source string")
    assert mixing.mixed(empty).select("rate").distinct().collect()[0].rate == 1.0


def test_chat_snapshots_collapse(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", None), (None, "bye")]
    rows = [(c, t, *talk[t]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1)) for t in range(n)] + [(5, 0, "user", "other"), (None, None, "user", "lost")]
    got = {r.conv_id: r for r in chat.collapsed(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert set(got) == {2, 5, None} and got[2].n_copies == 2 and got[2].n_turns == 4
    assert got[2].rendered.startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n")
    long = [(9, i, "user", str(i)) for i in range(2500)]
    parts = chat.collapsed(spark.createDataFrame(long, "conv_id int, turn int, role string, text string")).orderBy("part").collect()
    assert [p.n_turns for p in parts] == [1024, 1024, 452] and parts[1].rendered.startswith("<|im_start|>user\n1024<")


def test_chat_of_equal_turns_is_cut_into_bounded_parts(spark):
    n = 2 * chat.BLOCK + 500
    hot = spark.range(n).selectExpr("CAST(NULL AS BIGINT) AS conv_id", "1 AS turn", "'user' AS role", "lpad(id % 1500, 5, '0') AS text")
    same = spark.range(n).selectExpr("7L AS conv_id", "CAST(NULL AS INT) AS turn", "'user' AS role", "'again' AS text")
    rows = chat.collapsed(hot.unionByName(same)).orderBy("part").collect()
    for conv, texts in ((None, sorted(f"{i % 1500:05d}" for i in range(n))), (7, ["again"] * n)):
        parts = [r for r in rows if r.conv_id == conv]
        assert [(r.part, r.n_turns) for r in parts] == [(0, chat.BLOCK), (1, chat.BLOCK), (2, 500)]
        assert "".join(r.rendered for r in parts) == "".join(f"{chat.START}user\n{t}{chat.END}\n" for t in texts)


def test_chat_of_no_turn(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string, block int")
    assert chat.collapsed(none).collect() == []


def test_quality_with_clashing_names(spark):
    text = "the cat sat on the mat and looked at the dog in the yard of a house by the sea"
    rows = spark.createDataFrame(
        [(1, text, "mine", -5, True, "r"), (2, None, "x", -6, True, "s"), (1, text, "mine", -5, True, "r")],
        "doc_id long, text string, _w string, n_words int, kept boolean, _row string")
    assert [tuple(r) for r in quality.kept_documents(rows).collect()] == [(1, text, "mine", -5, True, "r")] * 2
    out = {(r.doc_id, r.n_words, r.kept, r._w, r._row) for r in quality.judged(rows).collect()}
    assert out == {(1, 20, True, "mine", "r"), (2, 0, False, "x", "s")}
    assert quality.judged(rows.limit(0)).collect() == []


def test_stop_words_judge_their_own_letters_only(spark):
    letters = "\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437"
    other = " ".join(letters[i % 8] + letters[i // 8 % 8] + letters[i // 64 % 8] + letters[i // 3 % 8] for i in range(300))
    latin = " ".join("xyzq"[i % 4] + "bcdf"[i // 4 % 4] + "ghjk"[i // 16 % 4] + "mnpr"[i // 64 % 4] + str(i) for i in range(300))
    rows = spark.createDataFrame([(1, other), (2, latin)], "doc_id long, text string")
    failed = {r.doc_id: r.failed_rules for r in quality.judged(rows).collect()}
    assert "stop_words" not in failed[1].split(",") and "stop_words" in failed[2].split(",")


def test_rollup_commits_once(spark):
    store = rollup.TokenRollup(spark, shared_folder(spark, "rollup-test"))
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint, op string, seq int")
    first = make([(1, "t", "a", "en", 5, "insert", 0), (2, "t", "a", None, 7, "insert", 0), (None, "t", None, "en", None, "insert", 0)])
    assert store.commit(0, first) and not store.commit(0, first)
    assert store.commit(1, make([(1, "t", "b", "en", 6, "revise", 0), (2, "t", "a", None, 0, "delete", 0), (8, "t", "a", "en", 0, "delete", 0)]))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert got == {("b", "en"): (1, 6), (None, "en"): (1, 0)}
    with pytest.raises(ValueError):
        store.commit(1, first)


def test_rollup_applies_in_order_of_commits(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint, op string, seq int")
    insert = make([(1, "t", "a", "en", 10, "insert", 0), (2, "t", "a", "en", 1, "insert", 0)])
    revise, delete = make([(1, "t", "a", "en", 4, "revise", 0)]), make([(1, "t", "a", "en", 0, "delete", 0)])
    for order, want in [((5, 3, 6), (1, 1)), ((1, 2, 3), (1, 1)), ((9, 8, 7), (1, 1))]:
        store = rollup.TokenRollup(spark, shared_folder(spark, "rollup-order"))
        for number, changes in zip(order, (insert, revise, delete)):
            assert store.commit(number, changes) and not store.commit(number, changes)
        assert [(r.n_docs, r.n_tokens) for r in store.totals().collect()] == [want]
    store = rollup.TokenRollup(spark, shared_folder(spark, "rollup-order"))
    assert store.totals().count() == 0
    assert store.commit(5, insert) and store.commit(6, delete) and store.commit(3, revise)  # comes back, as it comes last
    assert [(r.n_docs, r.n_tokens) for r in store.totals().collect()] == [(2, 5)]
    assert store.commit(7, insert.limit(0)) and store.totals().count() == 1


def test_katz_scores_do_not_hang_on_the_order_of_rows(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(0, 30), 40)) for i in range(60)] + [(7, None), (None, "w1x w2x"), (3, ""), (3, "")] + [(90, "w1x w2x w3x")] * 3
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id int, text string, row string, copies int")
    training = crc_fold(F.col("doc_id"), 10) != 0
    one, other = (sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in katz.scored(d, training).collect()], key=repr)
                  for d in (docs, docs.repartition(5)))
    assert one == other and len(one) == len(rows)
    assert {r[2] for r in one if r[0] == 90} == {4} and {r[2] for r in one if r[0] == 7} == {1, len(words_of(dict(rows[:60])[7])) + 1}
    assert katz.scored(docs.limit(0), training).count() == 0


def test_clashing_ids_lose_no_text(spark):
    rng = random.Random(8)
    long, other = prose(rng, 150, 10**6), prose(rng, 150, 10**6)
    rows = [(0, long), (1, long), (1, other), (2, other), (3, long), (4, "short"), (4, long), (5, long), (5, long)]
    docs = spark.createDataFrame([(i, t, "q", "r") for i, t in rows], "doc_id int, text string, _id string, _spans string")
    got = passages.without_spans(docs, passages.repeated_spans(docs)).collect()
    assert sorted((r.doc_id, r.text.strip()) for r in got) == sorted(
        [(0, long), (1, long), (1, other), (2, other), (3, ""), (4, "short"), (4, long), (5, ""), (5, "")])


def test_languages_with_short_or_long_texts_only(spark):
    rng = random.Random(9)
    stock = {"ab": "the cat sat on a mat and saw many dogs".split(), "cd": "der hund sah eine katze auf dem dach".split(), "ef": "le chat voit un chien sous la table".split()}
    say = lambda lang, n: " ".join(rng.choice(stock[lang]) for _ in range(n))
    rows = [(i, say("ab", 6), "ab") for i in range(40)] + [(100 + i, say("cd", 2000), "cd") for i in range(3)] + [(200 + i, say("ef", 60), "ef") for i in range(20)]
    learned = language.dictionaries(spark.createDataFrame(rows + [(300, "??", "gh"), (301, None, "gh")], "doc_id int, text string, lang string"))
    assert {lang for lang, _ in learned} == {"ab", "cd", "ef"}
    asked = [(i, say(lang, 8), lang) for i, lang in enumerate(["ab", "cd", "ef"] * 10)]
    odd = [(90, "\u00b2\u00b3\u00bd", "und"), (91, "\u2163 12", "und"), (92, None, "und")]
    got = {r.doc_id: r.lang_pred for r in language.identified(spark.createDataFrame(asked + odd, "doc_id int, text string, want string"), learned).collect()}
    assert sum(got[i] == lang for i, _, lang in asked) >= 27 and all(got[i] == want for i, _, want in odd)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "i will kill you"), (2, None), (3, ""), (3, "")], "doc_id int, text string")
    entries, weights = toxicity.learned(docs, spark.createDataFrame([], "doc_id int, toxic int"))
    got = toxicity.matched(docs, entries, weights).collect()
    assert entries == [] and len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert max(got, key=lambda r: r.score).doc_id == 1
    assert toxicity.matched(docs.limit(0), entries, weights).count() == 0


def test_mixing_with_clashing_names(spark):
    docs = spark.createDataFrame([(i, "t", "en", "a", 1, 5, 6) for i in range(20)], DOCS + ", _source int, _steps int")
    got = mixing.mixed(docs)
    assert set(docs.columns) <= set(got.columns) and {(r._source, r._steps) for r in got.collect()} == {(5, 6)}


def test_language_of_held_out_texts(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = language.dictionaries(documents.filter(crc_fold(F.col("doc_id"), 5) != 0))
    got = language.identified(documents, learned).join(documents.select("doc_id", "lang"), "doc_id").filter(crc_fold(F.col("doc_id"), 5) == 0).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?")], "doc_id int, text string")
    assert {r.lang_pred for r in language.identified(odd, learned).collect()} == {"und"}
    assert language.identified(odd, []).count() == 3


def test_toxicity_reads_clauses():
    ask = toxicity.Scorer([("idiot", False, 0.9), ("clown", True, 0.9)])
    plain, aimed, denied, said = (ask(t)[0] for t in ("an idiot", "you are an idiot", "not an idiot", "he said an idiot"))
    assert aimed > plain > said > denied > 0
    assert ask("i will kill you")[0] > 0 and ask("they kill time")[0] == 0 and ask("clownish")[0] > 0
    assert ask(None)[0] == ask("")[0] == ask("idiotic")[0] == 0


def test_templates_catch_other_values(spark):
    item = "Anna has 12 apples and gives 5 apples to her friend Tom , how many apples does dear Anna still keep at home now ?"
    other = "Maria has 40 apples and gives 7 apples to her friend Ben , how many apples does dear Maria still keep at home now ?"
    mixed_up = other.replace("dear Maria", "dear Ben").replace("friend Ben", "friend Ben")
    rows = [(1, f"so {item} yes"), (2, f"Well , {other} ok"), (3, "nothing to see in this text , it has some words only"), (4, None), (5, ""), (6, item.upper())]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short one")], "item_id int, text string")
    found = {r.doc_id: r for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id int, text string"), bench).collect()}
    assert set(found) >= {1, 2} and not set(found) & {3, 4, 5} and found[1].same_values and not found[2].same_values
    assert mixed_up != other
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()} >= {3, 4, 5}


def test_parts_of_items_are_found(spark):
    """Excerpts, pieces far apart and changed words, each with less than half of the windows at one place."""
    rng = random.Random(4)
    item = prose(rng, 59, 10**6).split()
    fill = lambda n: prose(rng, n, 10**6)
    changed = [w if k % 12 else f"other{k}" for k, w in enumerate(item)]
    pieces = [" ".join(item[k:k + 12]) for k in (0, 9, 18, 27, 36, 45)]
    rows = [
        (1, f"{fill(9)} {' '.join(item[20:45])} {fill(9)}"), (2, f" {fill(40)} ".join(pieces)), (3, f"{fill(5)} {' '.join(changed)} {fill(5)}"),
        (4, f"{fill(9)} {' '.join(item[20:33])} {fill(9)}"), (5, f"{fill(9)} {' '.join(item[20:32])} {fill(9)}"), (6, fill(90)), (7, " ".join(item))]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")
    found = {r.doc_id: r.n_found for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id int, text string"), bench).collect()}
    assert found == {1: 18, 2: 30, 3: 19, 4: 6, 7: 52}


def test_questions_with_names_at_the_head_of_sentences(spark):
    """Short sentences that begin with names, asked again with other names and numbers; sums, found word for word only."""
    ask = "{0} has {1} red apples. {0} eats {2} of them. {0} buys {3} green pears. How many fruits does {0} have?".format
    sums = "Work out 3 + 4 + 5 - 6 and then 12 * 7 / 3"
    bench = spark.createDataFrame([(1, ask("Anna", 12, 3, 5)), (2, "12 km 5 kg 7 m 9 g 11 cm 13 mm 15 l 17 ml"), (3, None), (4, "")], "item_id int, text string")
    rows = [
        (1, ask("Anna", 12, 3, 5)), (2, f"Some remarks. {ask('Boris', 40, 8, 6)} So much for that."), (3, ask("anna", 12, 3, 5)),
        (4, "Carla has 12 red apples. Dora eats 3 of them. Emil buys 5 green pears. How many fruits does Franz have?"),
        (5, "note: 12 km 5 kg 7 m 9 g 11 cm 13 mm 15 l 17 ml done"), (6, "note: 13 km 6 kg 8 m 1 g 12 cm 14 mm 16 l 18 ml done"),
        (7, "Anna has some red flowers. Boris sells them. How many fruits does Carla like? Dora buys none."), (8, sums), (9, None), (10, ""), (2, "the same id again")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = {(r.doc_id, r.item_id): r.same_values for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {(1, 1): True, (2, 1): False, (3, 1): True, (5, 2): True}
    empty = spark.createDataFrame([], docs.schema)
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_katz_is_normalised(spark, order):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a b c d e f g h i j".split()[: rng.randrange(2, 10)]) for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    model = katz.Katz.train(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"), order)
    tables = [{(r.hist, r.w): (r.logp, r.lower) for r in model.grams(n).collect()} for n in range(1, order + 1)]
    alphas = [{r.hist: r.logalpha for r in model.backoff(n).collect()} for n in range(1, order + 1)]
    vocabulary = {w for _, w in tables[0]} | {-1}

    def probability(hists, w):
        for n in range(len(hists), 0, -1):
            if (hists[n - 1], w) in tables[n - 1]:
                return 10 ** (sum(alphas[k - 1].get(hists[k - 1], 0.0) for k in range(n + 1, len(hists) + 1)) + tables[n - 1][hists[n - 1], w][0])
        return 10 ** sum(alphas[k - 1].get(hists[k - 1], 0.0) for k in range(1, len(hists) + 1))

    assert math.isclose(sum(probability([0], w) for w in vocabulary), 1.0, rel_tol=1e-9)
    for hist, lower in {(h, v[1]) for (h, _), v in tables[1].items()}:
        assert math.isclose(sum(probability([lower, hist], w) for w in vocabulary), 1.0, rel_tol=1e-9)


def test_katz_base_score_by_hand(spark):
    rows = [(i, t) for i, t in enumerate(["a b a", "b c", "", None, "a a z", "q"])]
    got = {r.doc_id: r for r in katz.scored(spark.createDataFrame(rows, "doc_id int, text string"), crc_fold(F.col("doc_id"), 10) != 0).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = collections.Counter(w for i, t in rows if not held[i] for w in [*words_of(t), "end"])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens = [*words_of(t), "end"]
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert math.isclose(got[i].base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel_tol=1e-9)
        assert got[i].score < 0


def test_katz_stores_few_bytes_a_token(spark):
    """Nearly every pair of words is new: neither the model nor what is stored for scoring has a wide row for each of them."""
    rng = random.Random(11)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(20000)}" for _ in range(3000))) for i in range(60)], "doc_id int, text string")
    shared_folder(spark, "katz-size")
    top = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in top.rglob("*") if f.is_file())
    before = size()
    assert katz.scored(docs, F.lit(True)).agg(F.sum("n_tokens")).first()[0] == 60 * 3001
    assert size() - before < 10 * 60 * 3001


@pytest.mark.parametrize("order", [1, 3])
def test_katz_blocks_agree_with_its_tables(spark, monkeypatch, order):
    """Texts in many blocks and buckets are scored as by joins with the tables, whether trained on or not."""
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(0, 40), 30), i % 4 > 0) for i in range(80)] + [(80, None, True), (80, "w1x", None), (None, "", False)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, training boolean").coalesce(1)
    whole = katz.Katz.train(docs, order, F.col("training")).scores().collect()
    monkeypatch.setattr(katz, "_BLOCK", 500)
    monkeypatch.setattr(katz, "_BUCKET", 100)
    model = katz.Katz.train(docs, order, F.col("training"))
    got = model.scores().collect()
    assert model.blocks.count() > 5 and len(got) == len(rows)
    plain = lambda found: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found], key=repr)
    assert plain(whole) == plain(got)
    later = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "row bigint, text string")
    want = {r.row: r.score for r in model.log_probabilities(katz.occurrences(later, order)).collect()}
    assert sorted(round(r.score, 9) for r in got) == sorted(round(v, 9) for v in want.values())
    grams = collections.Counter(t for _, text, training in rows if training for t in [*words_of(text), "end"])
    assert sorted(r.c for r in model.grams(1).collect()) == sorted(grams.values())
    assert all(model.grams(n).agg(F.sum("c")).first()[0] == sum(grams.values()) for n in range(1, order + 1))
