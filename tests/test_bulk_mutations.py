"""Many inputs at once: one join, appended files, DataFrames as results."""

from test_mutations import MODEL, NOW, ok, world  # noqa: F401

from sparkloom.plans.auth import User


def rows(e, text):
    return e.query(text).data()


def test_new_rows_are_appended(world):
    store, m, e = world
    for k in range(3):
        ok(m, 'mutation { createMain(input: {key: "k%d", createSubs: [{name: "s"}]}) { id } }' % k)
    at = store.manifest()
    assert len(at["mains"]) == 3 and len(at["subs"]) == 3 and all(len(v) == 3 for k, v in at.items() if k.startswith("_edges/"))
    ok(m, 'mutation { updateMain(input: {id: "i1", n: 4}) { id } }')
    assert len(store.manifest()["mains"]) == 1 and len(store.manifest()["subs"]) == 3
    assert rows(e, "{ allMains(orderBy: key_ASC) { key n subs { name } } }")["allMains"] == [{"key": f"k{k}", "n": 4 if k == 0 else None, "subs": [{"name": "s"}]} for k in range(3)]


def test_folders_are_merged_in_the_end(world, monkeypatch):
    store, m, e = world
    monkeypatch.setattr("sparkloom.operators.store.MOST_FOLDERS", 3)
    for k in range(5):
        ok(m, 'mutation { createMain(input: {key: "k%d"}) { id } }' % k)
    assert len(store.manifest()["mains"]) == 2
    assert len(rows(e, "{ allMains { key } }")["allMains"]) == 5


def test_many_updates_are_one_join(world):
    store, m, e = world
    ok(m, "mutation { createMains(input: [%s]) { id } }" % ", ".join('{key: "k%d", n: %d, accessGroup: "x"}' % (k, k) for k in range(30)))
    inputs = [{"id": f"i{k + 1}", **({"n": 100 + k} if k % 2 else {"text": f"t{k}", "n": None} if k % 4 else {"day": "2024-02-03"})} for k in range(25)]
    inputs.append({"id": "i30", "addTo_n": 1000})
    got = ok(m, "mutation($i: [UpdateMainInput!]!) { updateMains(input: $i) { key n text day } }", variables={"i": inputs})["updateMains"]
    want = []
    for k in range(25):
        want.append({"key": f"k{k}", "n": 100 + k if k % 2 else None if k % 4 else k, "text": f"t{k}" if k % 4 == 2 else None, "day": None if k % 4 else "2024-02-03"})
    assert got == [*want, {"key": "k29", "n": 1029, "text": None, "day": None}]
    assert [x["n"] for x in rows(e, "{ allMains(orderBy: key_ASC, filter: {key_in: [\"k25\", \"k26\"]}) { n } }")["allMains"]] == [25, 26]
    for bad, code in (([{"id": "i1", "key": "same"}, {"id": "i2", "key": "same"}], "UNIQUE_CONSTRAINT_VIOLATION"), ([{"id": "i1", "n": 1}, {"id": "no", "n": 1}], "NOT_FOUND"), ([{"id": "i1", "n": "x"}, {"id": "i2", "n": 1}], "BAD_INPUT"), ([{"id": "i1", "_revision": "old"}, {"id": "i2", "n": 1}], "REVISION_MISMATCH")):
        assert m.execute("mutation($i: [UpdateMainInput!]!) { updateMains(input: $i) { key } }", variables={"i": bad})[1][0].code == code
    user = User(("g-x",))
    assert m.execute("mutation($i: [UpdateMainInput!]!) { updateMains(input: $i) { key } }", variables={"i": [{"id": "i1", "accessGroup": "y"}, {"id": "i2", "n": 1}]}, user=user)[1][0].code == "PERMISSION_DENIED"


def test_revision_that_fits(world):
    _, m, e = world
    ok(m, 'mutation { createMains(input: [{key: "a", n: 1}, {key: "b", n: 2}]) { id } }')
    rev = [x["_revision"] for x in rows(e, "{ allMains(orderBy: key_ASC) { _revision } }")["allMains"]]
    ok(m, "mutation($i: [UpdateMainInput!]!) { updateMains(input: $i) { key } }", variables={"i": [{"id": "i1", "n": 5, "_revision": rev[0]}, {"id": "i2", "n": 6, "_revision": rev[1]}]})
    _, problems = m.execute('mutation { updateMain(input: {id: "i1", n: 7, _revision: "%s"}) { id } }' % rev[0])
    assert problems[0].code == "REVISION_MISMATCH"


def test_links_of_many_objects(world):
    _, m, e = world
    ok(m, 'mutation { f: createFriend(input: {name: "f"}) { id } s: createSubs(input: [{name: "s1"}, {name: "s2"}]) { id } m: createMains(input: [{key: "a", friend: "i1", subs: ["i2", "i3"]}, {key: "b", friend: "i1", subs: ["i3"]}, {key: "c", createSubs: [{name: "n1"}, {name: "n2"}]}]) { id } }')
    q = "{ allMains(orderBy: key_ASC) { friend { name } subs(orderBy: name_ASC) { name } } }"
    assert rows(e, q)["allMains"] == [{"friend": None, "subs": [{"name": "s1"}]}, {"friend": {"name": "f"}, "subs": [{"name": "s2"}]}, {"friend": None, "subs": [{"name": "n1"}, {"name": "n2"}]}]
    ok(m, 'mutation { updateMain(input: {id: "i4", addSubs: ["i2", "i2", "i3"]}) { id } }')
    assert rows(e, q)["allMains"][0]["subs"] == [{"name": "s1"}, {"name": "s2"}] and rows(e, q)["allMains"][1]["subs"] == []
    ok(m, 'mutation { updateMain(input: {id: "i4", subs: ["i2"]}) { id } }')
    assert rows(e, q)["allMains"][0]["subs"] == [{"name": "s1"}]


def test_results_as_frames(world):
    store, m, e = world
    ok(m, "mutation { createMains(input: [%s]) { id } }" % ", ".join('{key: "k%d", n: %d}' % (k, k) for k in range(9)))
    got = ok(m, "mutation { updateAllMains(filter: {n_gt: 4}, input: {addTo_n: 10}) { key n } }", frames=True)["updateAllMains"]
    assert sorted((r.key, r.n) for r in got.collect()) == [(f"k{k}", k + 10) for k in range(5, 9)]
    got = ok(m, "mutation { deleteAllMains(filter: {n_gt: 15}) { key } }", frames=True)["deleteAllMains"]
    assert sorted(r.key for r in got.collect()) == ["k6", "k7", "k8"]
    assert len(rows(e, "{ allMains { key } }")["allMains"]) == 6
