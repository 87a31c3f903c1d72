"""Members of undecided leader pairs meet by shingle; each member's whole list is not copied for each of its leader's pairs."""

import itertools
import random

from deltaweave.llm import ngram_join

from test_llm import docs_frame, parts, prose


def test_members_are_matched_by_leader_and_shingle(spark, monkeypatch):
    asked, overlaps = [], ngram_join._overlaps

    def watch(pairs, *rest):
        asked.append(pairs._jdf.queryExecution().analyzed().toString())
        return overlaps(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_overlaps", watch)
    rng = random.Random(5)
    base = prose(rng, 60).split()
    texts = [" ".join(base[:i] + ["other"] + base[i:]) for i in range(0, 60, 4)]
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_sets(docs_frame(spark, texts)).collect()}
    assert len(asked) == 3 and set(found.values()) == {min(found)}
    assert not any(f"Join Inner, ({s}_node" in asked[2] for s in "xy")


def test_only_early_entries_of_members_meet(spark, monkeypatch):
    made, near = [], ngram_join._near_members

    def watch(both_have, whose, s, other, t):
        out = near(both_have, whose, s, other, t)
        leader, radius = {"x": ("a", "rb"), "y": ("b", "ra")}[s]
        whole = both_have.join(whose.withColumnRenamed("leader", leader), [leader, "token"]).where(f"dab - d - {radius} <= 0.15 + 1e-9")
        made.append((out.count(), whole.count()))
        return out

    monkeypatch.setattr(ngram_join, "_near_members", watch)
    rng = random.Random(8)
    base = prose(rng, 120).split()
    texts = []
    for k in [1, 2, 3, 4, 5, 6] * 10:
        w = list(base)
        for i in rng.sample(range(120), k):
            w[i] = rng.choice(["one", "two", "three"])
        texts.append(" ".join(w))
    sets = [set(zip(*(x.split()[i:] for i in range(4)))) for x in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) * 100 >= len(sets[i] | sets[j]) * 85]
    want = parts(len(texts), links)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_sets(docs_frame(spark, texts)).collect()}
    ids = sorted(found)
    assert all((found[ids[i]] == found[ids[j]]) == (want[i] == want[j]) for i, j in itertools.combinations(range(len(ids)), 2))
    assert sum(whole for _, whole in made) > 0 and sum(few for few, _ in made) < sum(whole for _, whole in made), made
