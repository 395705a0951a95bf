"""Training-data operators against brute force, exact round trips and small hand-made cases."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tomeline.llm import chunking, conversations, knn, language, mixing, packing, pairs, pii, sentences, tokens


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- 1
def test_label_model_follows_the_better_functions():
    seen = {(1, 1, 1): 40, (1, -1, 1): 10, (-1, -1, -1): 900, (-1, 1, -1): 50, (0, 0, 0): 5}
    post = pairs.fit_label_model(list(seen.items()))
    assert post[1, 1, 1] > 0.9 > 0.2 > post[-1, -1, -1]
    assert post[-1, 1, -1] < 0.5
    assert pairs.fit_label_model([]) == {}


@pytest.mark.parametrize("answer, defect", [(None, "empty"), ("", "empty"), ("<p></p>", "empty"), ("TBD", "empty"), ("- \n- ", "empty")])
def test_votes_for_empty(answer, defect):
    assert sum(pairs.votes("Where is it?", answer, None, pairs.Weights(language.Weights()))[defect]) > 0


def test_votes_for_copied_and_refusal():
    assert pairs.votes("How old is the mill?", "> how old is the mill\n", None, pairs.Weights(language.Weights()))["copied"] == (1, 1, 1)
    assert pairs.votes("How old is the mill?", "The mill is old.", None, pairs.Weights(language.Weights()))["copied"][0] == -1
    assert pairs.votes("How old?", "In short: I don't know.", False, pairs.Weights(language.Weights()))["refusal"][0] == 1
    assert pairs.votes("How old?", "I can't stress this enough: it is ninety.", False, pairs.Weights(language.Weights()))["refusal"][0] != 1


@pytest.mark.parametrize(
    "answer, declines",
    [
        ("I have no idea about that.", True), ("The documents provided don't contain this.", True), ("Das ist mir leider nicht bekannt.", True), ("Je l'ignore.", True), ("No tengo información sobre eso.", True), ("Tôi chưa tìm thấy thông tin nào.", True),
        ("我不知道。", True), ("申し訳ありませんが、分かりません。", True), ("NOT_FOUND", True), ("The mill is not far from the river.", False), ("The first page does not mention it, but the second one does: ninety.", False), ("Nobody may open the gate without a note from the answer desk.", False),
    ],
)
def test_refusals_in_fresh_wordings(answer, declines):
    votes = pairs.votes("How old is the mill?", answer, None, pairs.Weights(language.Weights()))["refusal"]
    assert (votes[0] == 1) == declines and (declines or -1 not in votes[2:3])


def test_wordings_are_learned_from_the_flag():
    odds = pairs.fit_flag([(f"The basket came home bare, topic {i}.", True) for i in range(8)] + [(f"The mill is {i} years old.", i == 3) for i in range(90)])
    learned = pairs.Weights(language.Weights(), odds)
    assert learned.score("The basket came home bare, subject nine.") > 1 > 0 > learned.score("The mill is 200 years old.") and learned.score("Something else") == 0
    assert pairs.fit_flag([("a b c", True)] * 5) == {}


def test_numbers_and_lists_at_the_end():
    weights = pairs.Weights(language.Weights())
    assert pairs.votes("How old?", "75.", None, weights)["truncated"][0] == -1
    assert pairs.votes("How old?", "It is old.\n1. Very.\n2.", None, weights)["truncated"][0] == 1


def test_scores_belong_to_their_fit():
    one, two = language.Weights({" der ": (0.0, -9.0, -1.0, -9.0, -9.0)}), language.Weights({" der ": (-9.0, -9.0, 0.0, -9.0, -9.0)})
    assert language.detect("der", one)[0] == "en" and language.detect("der", two)[0] == "de"


def test_defects_end_to_end(spark):
    good = [(i, f"How old is mill {i}?", f"The mill is {i} years old. It stands by the river.") for i in range(30)]
    bad = [(100, "How old is the mill?", None), (101, "How old is the mill?", "How old is the mill?"), (102, "How old is the mill?", "I don't know."), (103, "How old is the mill?", "The mill is 9 years old. It stands by the,"), (104, "How old is the mill?", "这座磨坊有九十年了，就在河边。"), (104, "How old is the mill?", "这座磨坊有九十年了，就在河边。"), (105, None, "The mill is 9 years old.")]
    df = spark.createDataFrame([("t", i, q, a, None) for i, q, a in good + bad], "src string, row_id long, query string, answer string, not_found boolean")
    docs = spark.createDataFrame([("The mill stands by the river and is very old, as everybody in the village knows.", "en"), ("Die Mühle steht am Fluss und ist sehr alt, wie jeder im Dorf weiß.", "de"), (None, None)], "text string, lang string")
    got = {r["row_id"]: r["defects"][0] for r in pairs.find_defects(df, docs).collect()}
    assert got == {100: "empty", 101: "copied", 102: "refusal", 103: "truncated", 104: "other_language"}
    assert pairs.find_defects(df.limit(0), docs.limit(0)).count() == 0


def test_fold_keeps_language_features():
    assert language.fold("Đầu Tư") == "dau tu"
    assert language.script_of("閉館後に冷蔵庫")[0] == "ja" and language.script_of("还书架现在在哪里")[0] == "zh"
    assert language.detect("27 %", language.Weights()) == (None, 0.0)


# --- 2
def kinds(text):
    return [k for *_, k in sorted(pii.numbers_and_addresses(text))]


@pytest.mark.parametrize(
    "text, found",
    [
        ("write to a.b+c@mail.example or x at pine dot example now", ["email", "email"]),
        ("Tag me with @shelf54 at noon, not at 78.", []),
        ("call 415-555-0139 or +44 (0)7700 900-123.", ["phone", "phone"]),
        ("Shelf no. 015550195. Lot 4821-7798 arrived. Build 10.4.2.31 fails.", []),
        ("my id is 666-12-3456", ["id_number"]),
        ("deliver to 12 Pebble Lane, Port Town, and to P.O. Box 33, Elmby", ["address", "address"]),
        ("five five five, zero one four three", ["phone"]),
        ("", []),
    ],
)
def test_local_parsers(text, found):
    assert kinds(text) == found


@pytest.mark.parametrize(
    "text, found",
    [
        ("six one two, three four eight nine", ["phone"]),
        ("oh oh oh, oh oh oh oh", ["phone"]),
        ("write to ada ( at ) mail.example", ["email"]),
        ("write to ada at pine (dot) example", ["email"]),
        ("12 quai des Lilas", ["address"]),
        ("7 impasse du Moulin", ["address"]),
        ("paseo de la Luna 14", ["address"]),
        ("12 pho Hoa Lan", ["address"]),
        ("bản Hoa, xã Lan", ["address"]),
        ("ấp Hoa, xã Lan", ["address"]),
    ],
)
def test_no_gate_hides_what_a_parser_accepts(text, found):
    assert kinds(text) == found


def test_redaction_learns_names_and_keeps_the_rest(spark):
    texts = [("m", str(i), "Thank you, Ada Marsh. All is well.") for i in range(3)] + [("m", "9", "ada marsh came by; mail ada@mail.example"), ("m", "10", None), ("m", "11", "   "), ("m", "9", "ada marsh came by; mail ada@mail.example")]
    out = {r["row_key"]: r for r in pii.redact(spark.createDataFrame(texts, "src string, row_key string, text string")).collect()}
    assert out["9"]["clean_text"] == "[NAME] came by; mail [EMAIL]"
    assert [(f["pii_type"], f["occ"]) for f in out["9"]["found"]] == [("name", 1), ("email", 1)]
    assert "10" not in out and out["11"]["found"] == []


@pytest.mark.parametrize(
    "text, found",
    [
        ("SSN 123456789", ["id_number"]), ("DNI 12345678Z", ["id_number"]), ("12345678Z", ["id_number"]), ("12345678A", []), ("11010519491231002X", ["id_number"]), ("110105194912310021", []),
        ("CPF 123.456.789-09", ["id_number"]), ("ring (020) 7946 0958", ["phone"]), ("call one two three four six eight nine one", ["phone"]), ("tel:+442079460958", ["phone"]), ("北京市海淀区中关村大街27号", ["address"]),
    ],
)
def test_identity_and_phone_shapes(text, found):
    assert kinds(text) == found


@pytest.mark.parametrize("text", ["1600 Pennsylvania Ave NW, Washington DC 20500", "14 Rue de Rivoli, Paris", "12 " + "Pebble" * 33 + " Lane, Port Town", "x" * 300 + "@" + "y" * 300 + ".example", "mailto:bob@mail.example"])
def test_spans_reach_to_the_edges(text):
    (start, end, _), = pii.numbers_and_addresses(text)
    assert (start, end) == (0, len(text))
    (start, end, _), = pii.numbers_and_addresses("Seen: " + text + " and more")
    assert (start, end) == (6, 6 + len(text))


def test_long_runs_are_read_in_linear_time():
    assert pii.numbers_and_addresses("x" * 300_000) == []
    assert len(pii.numbers_and_addresses("ab@cd.example " * 2_000)) == 2_000


NO_WORDS = {r: set() for r in (*pii.ROLES, "like", "left", "right", "every")}


@pytest.mark.parametrize("text, name", [("My colleague Priya Raman will join.", "Priya Raman"), ("All is well.\nRegards, Ben Carter", "Ben Carter"), ("Please forward to Tom Becker today", "Tom Becker"), ("Dear Ms Okoro, hello", "Ms Okoro"), ('{"name": "Lea Brandt"}', "Lea Brandt"), ("Contact: Zoë L. Kern", "Zoë L. Kern")])
def test_general_cues_give_names_and_evidence(text, name):
    assert [text[a:b] for a, b, _ in pii.find_names(text, [], NO_WORDS)] == [name]
    assert [sure for *_, sure in pii.name_runs(text, [])[1]] in ([True], [True, True]) or "L. " in text


def learned(df):
    return pii.name_words(pii.evidence(df.withColumns({"h": F.lit(1).cast("long"), "g": F.lit(1).cast("long")})))


def test_name_share_counts_every_text(spark):
    texts = ["Signed, Ada Marsh."] * 2 + [f"The marsh lay wet, ada {i}." for i in range(60)]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, times long")
    assert learned(df).where("role in ('given', 'sur')").count() == 0  # 2 of 62 occurrences
    assert rows(learned(df.limit(30)).where("role in ('given', 'sur')")) == [("given", "ada"), ("sur", "marsh")]


def test_cues_are_learned_from_names(spark):
    known = [f"Signed, {g} {s}." for g, s in (("Ada", "Marsh"), ("Ben", "Thorn"), ("Cem", "Yıldız")) for _ in range(3)]
    beside = [f"Today {n} fed the geese, and Blue Heron guide {i} is torn." for i, n in enumerate(("Ada Marsh", "Ben Thorn", "Cem Yıldız", "Dov Halper"))]
    words = rows(learned(spark.createDataFrame([(t, 1) for t in known + beside * 2], "text string, times long")))
    assert ("right", "fed the") in words and ("given", "dov") in words and ("given", "blue") not in words


def test_repeated_texts_are_read_once_and_given_each(spark):
    df = spark.createDataFrame([("m", str(i), "Signed, Ada Marsh, ada@mail.example") for i in range(5)] + [("m", "5", "")], "src string, row_key string, text string")
    out = rows(pii.redact(df).select("row_key", "clean_text"))
    assert out == [*((str(i), "Signed, [NAME], [EMAIL]") for i in range(5)), ("5", "")]


# --- 3
@pytest.mark.parametrize("text", ["word " * 900, "x" * 3000, "# A\n\n" + "One two. " * 300 + "\n\n## B\n\n" + "z" * 1500, "你好。" * 900, "á" * 1500])
def test_pieces_fit_overlap_and_join_again(text):
    pieces = chunking.split_text(text, 100, 10)
    assert all((b - a) // 4 <= 100 for a, b, _ in pieces)
    assert all(pieces[i][0] == pieces[i - 1][1] - 40 for i in range(1, len(pieces)))
    assert text[pieces[0][0] : pieces[0][1]] + "".join(text[pieces[i - 1][1] : pieces[i][1]] for i in range(1, len(pieces))) == text


def test_small_and_null_items_give_no_piece(spark):
    items = spark.createDataFrame([("pages", "a", None, 1), ("pages", "b", "x" * 16, 1), ("pages", "c", "x" * 20, 1), ("pages", "c", "x" * 20, 2)], "src string, item_key string, text string, max_tokens int")
    limits = spark.createDataFrame([("pages", 4, 9)], "item string, max_tokens int, overlap_tokens int")
    got = chunking.split_oversized(items, limits)
    assert {r["item_key"] for r in got.collect()} == {"c"} and got.groupBy("item_key", "piece").count().where("count > 1").count() == 0


# --- 4
def test_neighbours_reach_recall_and_keep_copies(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, 3000)] + 0.35 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[2980:3000] = x[0]
    data = [(i, [float(v) for v in x[i]]) for i in range(3000)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, 2.0])]
    df = spark.createDataFrame(data, "id long, v array<float>")
    near = knn.nearest(*knn.neighbour_graph(knn.pack_vectors(df, "id", "v")))
    got = {}
    for r in near.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"], r["cosine"]))
    assert set(got) == set(range(3000))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for i in range(0, 2980, 20):
        s = u @ u[i]
        s[i] = -2
        kth = np.sort(s)[-10]
        hit += sum(s[o] >= kth - 1e-4 for _, o, _ in got[i])
        total += 10
    assert hit / total >= 0.9
    assert [o for _, o, _ in sorted(got[2999])] == [0, *range(2980, 2989)]


def test_greedy_search_reaches_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 2500)] + 0.4 * rng.normal(size=(2500, 16))).astype(np.float32)
    packed = knn.pack_vectors(spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(2500)], "id long, v array<float>"), "id", "v")
    graph, _ = knn.neighbour_graph(packed, keep_vectors=True)
    found = knn.search(packed.where("nid % 20 = 0"), graph, graph.select("nid", "home")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for i in range(0, 2500, 20):
        s = u @ u[i]
        s[i] = -2
        kth = np.sort(s)[-10]
        hit += sum(s[r["nid"]] >= kth - 1e-4 for r in found if r["qid"] == i)
    assert hit / 1250 >= 0.9 and all(r["qid"] != r["nid"] for r in found)


def test_greedy_search_walks_on_through_other_parts(spark):
    angle = np.linspace(0, 2.0, 40)
    x = np.stack([np.cos(angle), np.sin(angle)], 1).astype(np.float32)
    data = [(i, [float(v) for v in x[i]]) for i in range(40)] + [(100, [float(v) for v in x[37]])]
    packed = {r["nid"]: r for r in knn.pack_vectors(spark.createDataFrame(data, "id long, v array<float>"), "id", "v").collect()}
    graph = []
    for i in range(40):  # a chain: each node knows the one before and after it; parts of eight nodes
        near = [j for j in (i - 1, i + 1) if 0 <= j < 40]
        ids, sims = np.full((1, knn.LIST), -1, np.int64), np.full((1, knn.LIST), -2, np.float32)
        ids[0, : len(near)], sims[0, : len(near)] = near, x[near] @ x[i]
        graph.append((i // 8, i, packed[i]["sp"], knn._lists(ids, ids // 8, sims, ids >= 0)[0].as_py(), packed[i]["vec"]))
    graph = spark.createDataFrame(graph, "home int, nid long, sp long, near binary, vec binary")
    asked = spark.createDataFrame([(100, packed[100]["sp"], packed[100]["vec"])], "nid long, sp long, vec binary")
    homes = spark.createDataFrame([(100, 0)], "nid long, home int")
    found = knn.search(asked, graph, homes, k=10, beam=16).collect()
    assert {r["nid"] for r in found} == set(range(30, 40))


def test_rounds_make_the_graph(spark):
    """A random start holds next to no true neighbours; the rounds find them, across parts too."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(9000, 12)).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    packed = knn.pack_vectors(spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(9000)], "id long, v array<float>"), "id", "v")
    s = u[::20] @ u.T
    s[np.arange(len(s)), np.arange(0, 9000, 20)] = -2
    kth = np.sort(s, axis=1)[:, -10]

    def recall(rounds):
        near = knn.nearest(*knn.neighbour_graph(packed, rounds=rounds)).where("id % 20 = 0").collect()
        return sum(r["cosine"] >= kth[r["id"] // 20] - 2e-5 for r in near) / (10 * len(kth))

    start, first, quiet = recall(0), recall(1), recall(None)
    assert start < 0.3 < 0.6 < first < quiet and quiet > 0.9, (start, first, quiet)


def test_lists_keep_the_best_distinct_neighbours():
    node, other = np.array([0, 0, 0, 0, 1]), np.array([2, 3, 2, 1, 0])
    near, sims, new = knn.best_lists(node, other, np.array([0.5, 0.9, 0.5, -0.2, 0.1]), np.array([True, True, False, True, True]), 3, 2)
    assert near.tolist() == [[3, 2], [0, -1], [-1, -1]] and new.tolist() == [[True, False], [True, False], [False, False]]
    assert np.allclose(sims, [[0.9, 0.5], [0.1, -2], [-2, -2]], atol=1e-6)


def test_a_vector_both_ends_ask_for_is_shipped_once():
    x = np.eye(4, dtype=np.float32)
    kept = knn._rows(knn.NODE, np.full(4, 3), np.arange(4) * 5, np.full(4, 4), kth=np.full(4, 0.5), vec=knn._binary(knn._pack(x)), at=3)
    wants = [b for by in (3, 8) for b in knn._bundles(knn.WANT, by, 4, np.array([8, 8]), np.array([3, 3]), np.array([5, 15]))]
    sent = knn._shipper(knn.pa.Table.from_batches([kept]), knn.pa.Table.from_batches(wants))
    assert sent["home"].to_pylist() == [8]
    nid, lives, kth, vec = knn._unsqueeze(sent["near"].to_pylist(), "i8", "i4", "f4", "V12")
    assert nid.tolist() == [5, 15] and lives.tolist() == [3, 3] and kth.tolist() == [0.5, 0.5]
    assert np.allclose(knn._unpack(vec), x[[1, 3]], atol=1e-4)


def test_a_part_that_has_a_vector_gets_only_its_cosine():
    x = np.eye(4, dtype=np.float32)
    kept = knn._rows(knn.NODE, np.full(4, 3), np.arange(4) * 5, np.full(4, 4), kth=np.arange(4) / 4, vec=knn._binary(knn._pack(x)), at=3)
    asks = [b for kind, ids in ((knn.WANT, [5, 15]), (knn.HAVE, [0, 15])) for b in knn._bundles(kind, 8, 4, np.array([8, 8]), np.array([3, 3]), np.array(ids))]
    sent = {r["kind"]: r["near"] for r in knn._shipper(knn.pa.Table.from_batches([kept]), knn.pa.Table.from_batches(asks)).to_pylist()}
    assert knn._unsqueeze([sent[knn.FAR]], "i8", "i4", "f4", "V12")[0].tolist() == [5]
    assert [c.tolist() for c in knn._unsqueeze([sent[knn.KNOWN]], "i8", "f4")] == [[15], [0.75]]


def test_no_vector_comes_to_a_part_twice_and_the_lists_are_the_same():
    """Rounds in four parts without Spark; with what parts have told, and, if told is False, with every vector sent again."""
    x = np.random.default_rng(13).normal(size=(1200, 8))
    raw = knn._pack(x / np.linalg.norm(x, axis=1, keepdims=True))
    part = np.arange(1200) % 4

    def rounds(told):
        placed = [b for p in range(4) for b in knn._bundles(knn.NODE, 0, 8, part[part == p], np.zeros(300), np.flatnonzero(part == p), raw[part == p])]
        away = np.arange(0, 1200, 5)  # these visit the next part
        placed += knn._bundles(knn.FAR, 0, 8, (part[away] + 1) % 4, np.zeros(240), away, part[away].astype(np.int32), np.full(240, -2, np.float32), raw[away])
        arrived = knn.pa.Table.from_batches(placed).cast(knn.ARROW_STATE)
        ids = lambda t: [(r["home"], int(i)) for r in t.to_pylist() if r["kind"] == knn.FAR for i in knn._unsqueeze([r["near"]], "i8", "i4", "f4", "V20")[0]]
        came, held = ids(arrived), []
        state = knn._part_round(1, True)(arrived)
        for number in (2, 3, 4):
            rows = state.to_pylist()
            held += [r for r in rows if r["kind"] == knn.HELD]
            some = lambda kinds, key, p, rows=rows: knn.pa.Table.from_pylist([r for r in rows if r["kind"] in kinds and r[key] == p], knn.ARROW_STATE)
            shipped = knn.pa.concat_tables([knn._shipper(some([knn.NODE], "at", p), some([knn.WANT, knn.HAVE] if told else [knn.WANT], "lives", p)) for p in range(4)])
            came += ids(shipped)
            stay = lambda p, some=some: knn.pa.concat_tables([some([knn.NODE], "at", p), knn.pa.Table.from_pylist([r for r in held if r["at"] == p], knn.ARROW_STATE)])
            for_part = lambda p, shipped=shipped: shipped.filter(knn.pc.equal(shipped["home"], p))
            state = knn.pa.concat_tables([knn._part_round(number, True)(stay(p), knn.pa.concat_tables([some([knn.FIND, knn.BACK], "home", p), for_part(p)])) for p in range(4)])
        return came, {r["nid"]: r["near"] for r in state.to_pylist() if r["kind"] == knn.NODE}

    (once, lists), (again, same) = rounds(True), rounds(False)
    assert len(once) == len(set(once)) and set(once) == set(again) and len(again) > len(once)
    assert lists == same and len(lists) == 1200


def test_finds_that_their_homes_have_weighed_are_not_sent_again():
    finds = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 2]), np.array([0.9, 0.8, 0.7, 0.6], np.float32)
    near = np.array([[3, 1], [-1, -1], [-1, -1]])  # node 0 lists place 3, the first of those that live elsewhere
    back = np.array([4]), np.array([2]), np.array([True])  # and the second of those lists node 2
    node, other, cosine = knn._unknown(finds, near, back, 3)
    assert (node.tolist(), other.tolist()) == ([0, 1], [1, 0]) and np.allclose(cosine, [0.8, 0.7])


def test_neighbours_of_nothing(spark):
    df = spark.createDataFrame([], "id long, v array<float>")
    assert knn.nearest(*knn.neighbour_graph(knn.pack_vectors(df, "id", "v"))).count() == 0


# --- 5
def test_conversations_by_stream(spark, tmp_path):
    m = [
        ("ok", 0, "user", "hi"), ("ok", 1, "Bot ", "hello"), ("ok", 1, "bot", "hello"), ("late", 1, "assistant", "b"), ("late", 0, "human", "a"),
        ("blank", 0, "user", " ​"), ("gap", 0, "user", "a"), ("gap", 2, "assistant", "b"), ("odd", 0, "system", "a"), ("two", 0, "user", "a"), ("two", 1, "assistant", "b"), ("two", 2, "assistant", "c"),
        ("open", 0, "user", "a"), ("mute", 0, "user", "a"), ("mute", 1, "assistant", ""), ("null", None, "user", "a"), ("ghost", 0, "user", "a"), (None, 0, "user", "a"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(m)], "id long, conversation_id string, turn int, role string, text string").withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")))
    df.coalesce(1).write.parquet(str(tmp_path / "messages.parquet"))
    from datetime import timedelta

    blocks = conversations.stream_blocks(spark, str(tmp_path / "messages.parquet"), df.schema, timedelta(hours=1), timedelta(days=1))
    listed = spark.createDataFrame([(c,) for c in ("ok", "late", "blank", "gap", "odd", "two", "open", "mute", "null", "alone", None, "ok")], "id string")
    verdicts = conversations.judge(blocks, listed)
    assert dict(rows(verdicts.where("reason is not null"))) == {"blank": "empty", "alone": "empty", "gap": "broken", "odd": "broken", "two": "broken", "null": "broken", "ghost": "broken", "open": "missing_reply", "mute": "missing_reply"}
    assert rows(conversations.rebuilt(blocks, verdicts)) == [("late", 0, "user", "a"), ("late", 1, "assistant", "b"), ("ok", 0, "user", "hi"), ("ok", 1, "assistant", "hello")]


def test_late_rows_over_several_batches(spark, tmp_path):
    """Rows out of order in later files: within the delay the stream takes them, beyond it they are added afterwards."""
    from datetime import timedelta

    day = 86_400
    files = [
        [("a", 0, "user", "q", 0), ("b", 0, "user", "q", 10), ("c", 1, "bot", "r", 20)],
        [("d", 0, "user", "q", 3 * day), ("b", 1, "bot", "r", 40)],
        [("c", 0, "user", "q", 15), ("a", 1, "bot", "r", 30), ("e", None, "user", "x", 5)],
        [("b", 1, "bot", "r", 45), ("d", 1, "bot", "r", 3 * day + 5), ("a", 2, "user", "more", 9 * day)],
    ]
    schema = "id long, conversation_id string, turn int, role string, text string, second long"
    n = 0
    for batch in files:
        frame = spark.createDataFrame([(n := n + 1, *r) for r in batch], schema).withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("second"))).drop("second")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "messages.parquet"))
        import time

        time.sleep(1.1)  # files are taken in the order of their time
    blocks = conversations.stream_blocks(spark, str(tmp_path / "messages.parquet"), frame.schema, timedelta(hours=1), timedelta(hours=1), files_per_trigger=1)
    assert rows(blocks.groupBy("conversation_id", "block").count().where("count > 1")) == []
    listed = spark.createDataFrame([(c,) for c in "abcde"], "id string")
    verdicts = conversations.judge(blocks, listed)
    assert rows(verdicts) == [("a", "missing_reply"), ("b", None), ("c", None), ("d", None), ("e", "broken")]
    assert rows(conversations.rebuilt(blocks, verdicts)) == [("b", 0, "user", "q"), ("b", 1, "assistant", "r"), ("c", 0, "user", "q"), ("c", 1, "assistant", "r"), ("d", 0, "user", "q"), ("d", 1, "assistant", "r")]


def test_blocks_of_a_long_conversation_meet(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK_TURNS", 3)
    data = [(i, "c", t, "user" if t % 2 == 0 else "assistant", "x") for i, t in enumerate([7, 3, 0, 1, 2, 5, 4, 6, 6])]
    df = spark.createDataFrame(data, "id long, conversation_id string, turn int, role string, text string").withColumn("created_at", F.current_timestamp())
    blocks = conversations.with_facts(conversations.in_blocks(conversations.message_rows(df)))
    listed = spark.createDataFrame([("c",)], "id string")
    assert blocks.count() == 3 and rows(conversations.judge(blocks, listed)) == [("c", None)]
    assert rows(conversations.judge(blocks.where("block <> 1"), listed)) == [("c", "broken")]
    nothing = conversations.with_facts(conversations.in_blocks(conversations.message_rows(df.limit(0))))
    assert rows(conversations.judge(nothing, listed)) == [("c", "empty")]


# --- 6
def test_fullest_equals_brute_force():
    import itertools

    for seed in range(40):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(1, 30, 9).tolist()
        room = int(rng.integers(10, 80))
        counts = {s: sizes.count(s) for s in sizes}
        chosen = packing.fullest(sorted(counts, reverse=True), counts, room)
        best = max(s for r in range(10) for c in itertools.combinations(sizes, r) if (s := sum(c)) <= room)
        assert sum(chosen) == best and all(chosen.count(c) <= counts[c] for c in chosen)


def test_packing_keeps_every_item_within_capacity(spark):
    rng = np.random.default_rng(1)
    sizes = [(i, int(s)) for i, s in enumerate(rng.integers(0, 700, 800))] + [(900, None), (901, 5000)]
    out = packing.pack_items(spark.createDataFrame(sizes, "item long, n_tokens long"), spark.createDataFrame([("s", 512)], "spec string, capacity_tokens int")).toPandas()
    assert (out.groupby("container")["n_tokens"].sum() <= 512).all()
    total = out.groupby("item")["n_tokens"].sum()
    assert all(total[i] == (s or 0) for i, s in sizes)
    assert set(out[out["part"] > 0]["item"]) == {i for i, s in sizes if (s or 0) > 512}
    assert out["n_tokens"].sum() / (512 * out["container"].nunique()) > 0.97
    assert packing.pack_items(spark.createDataFrame([], "item long, n_tokens long"), spark.createDataFrame([("s", 512)], "spec string, capacity_tokens int")).count() == 0


# --- 7
def test_mixture_reaches_shares_under_caps(spark):
    docs = [(i, [" Web", "wiki", "tiny", "other", None][min(4, i % 7)], 10 + i % 5) for i in range(3000)] + [(9000, "web", 0), (9001, "web", None)]
    targets = spark.createDataFrame([("web", 0.5, 1), ("wiki", 0.3, 1), ("tiny", 0.1, 2), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, n_tokens long"), targets)
    r = {x["source"]: x for x in report.collect()}
    assert r["none"]["used_tokens"] == 0 and abs(r["web"]["actual_share"] - 0.5 / 0.9) < 0.01 and abs(r["tiny"]["actual_share"] - 0.1 / 0.9) < 0.01
    uses = mixture.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("m")).collect()
    assert all(u["m"] <= {"web": 1, "wiki": 1, "tiny": 2}[u["source"]] for u in uses)
    assert all(x["used_tokens"] <= x["budget_tokens"] for x in r.values())
    empty, report = mixing.mix(spark.createDataFrame([], "doc_id long, source string, n_tokens long"), targets)
    assert empty.count() == 0 and report.count() == 4


def test_small_source_repeats_whole_epochs(spark):
    docs = spark.createDataFrame([(i, "big", 10) for i in range(100)] + [(200 + i, "tiny", 10) for i in range(5)], "doc_id long, source string, n_tokens long")
    goal = spark.createDataFrame([("big", 0.9, 1), ("tiny", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixture, _ = mixing.mix(docs, goal, total_tokens=1000)
    assert rows(mixture.where("source = 'tiny'").groupBy("epoch").count()) == [(1, 5), (2, 5)]


# --- 8
@pytest.mark.parametrize(
    "text, expected",
    [
        ("Dr. Vane met us. It was 5.30 p.m. on Friday.", ["Dr. Vane met us.", "It was 5.30 p.m. on Friday."]),
        ("The sign reads “Shut. Go home.” and nobody minds. Next one.", ["The sign reads “Shut. Go home.” and nobody minds.", "Next one."]),
        ("它关了。“真的？”他问。好", ["它关了。", "“真的？”他问。", "好"]),
        ("# Title\n\n1. First item. More\n2. Second", ["# Title", "1. First item.", "More", "2. Second"]),
        ("पहला वाक्य। दूसरा वाक्य।", ["पहला वाक्य।", "दूसरा वाक्य।"]),
        ("It ended.The next began. [1] Then", ["It ended.", "The next began.", "[1] Then"]),
        ("Bring tape, etc. The rest waits. The", ["Bring tape, etc.", "The rest waits.", "The"]),
        ("   ", []),
        (None, []),
    ],
)
def test_sentence_units(text, expected):
    ends = sentences.sentence_ends(text, plain=frozenset({"the"}))
    last, got = 0, []
    for e in ends:
        got.append(text[last:e].strip())
        last = e
    if "[1]" not in (text or ""):
        assert got == expected
    else:
        assert got[0] == expected[0]


def test_sentences_cover_every_visible_letter(spark):
    docs = [(1, "Ab c. De f! Gh?\n\n- i j\n- k"), (1, "Ab c. De f! Gh?\n\n- i j\n- k"), (2, None), (3, "\t"), (4, "x" * 50_000 + ". Y")]
    out = sentences.split_sentences(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    for i, text in docs:
        own = out[out.doc_id == i].sort_values("end_pos")["sentence"]
        assert "".join("".join(own).split()) == "".join((text or "").split())


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")
def test_token_counts(spark):
    got = dict(rows(tokens.with_tokens(spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id long, text string"), ["doc_id"], "text")))
    assert got == {1: 2, 2: 0, 3: 0} and not math.isnan(got[1])


def test_search_gives_every_copy(spark, tmp_path):
    from tomeline.llm.queries import p4_search

    rows = [(i, [float(np.sin(i * j + j * j)) for j in range(1, 9)]) for i in range(60)]
    rows += [(100, rows[20][1]), (120, rows[20][1]), (121, rows[7][1])]
    for name in ("questions", "answer_cache"):
        spark.createDataFrame(rows, "id long, embedding array<float>").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {}
    for r in p4_search(spark, str(tmp_path)).where("src = 'questions'").orderBy("rank").collect():
        got.setdefault(r.id, []).append((r.other, r.cosine))
    assert got[20][:2] == [(100, 1.0), (120, 1.0)] and got[100][:2] == [(20, 1.0), (120, 1.0)]
    assert {len(x) for x in got.values()} == {10}
    assert all({7, 121} <= {o for o, _ in x} or not {7, 121} & {o for o, _ in x[:-1]} for x in got.values())
