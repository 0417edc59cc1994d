import pytest

from lettermill.operators import components
from lettermill.operators.components import connected_components
from lettermill.operators.threads import cluster, members

EMAIL = "id string, message_id string, in_reply_to string, references string, subject_key string, ingest_order long"


def groups(spark, emails, keys=(), **kw):
    rows = [({"id": None, "message_id": f"<{e['id']}@example.com>", "in_reply_to": None, "references": None, "subject_key": "",
        "ingest_order": n} | e) for n, e in enumerate(emails)]
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in EMAIL.split(", ")) for r in rows], EMAIL)
    out = {}
    for r in cluster(frame, spark.createDataFrame(list(keys), "email_id string, kind string, value string"), **kw).collect():
        out.setdefault(r.cluster_id, set()).add(r.email_id)
    return sorted(map(frozenset, out.values()), key=sorted)


def together(spark, *args, **kw):
    return any({"a", "b"} <= g for g in groups(spark, *args, **kw))


AB = [{"id": "a"}, {"id": "b"}]


def test_shared_and_different_references(spark):
    assert together(spark, AB, [("a", "job", "1"), ("b", "job", "1")])
    assert not together(spark, AB, [("a", "job", "1"), ("b", "job", "2")])


def test_round_up_does_not_bridge_but_its_container_does(spark):
    three = [*AB, {"id": "c"}]
    keys = [("a", "job", "1"), ("b", "job", "2"), ("c", "job", "1"), ("c", "job", "2")]
    assert len(groups(spark, three, keys)) == 3
    assert groups(spark, three, [*keys, ("c", "container", "x"), ("a", "container", "x"), ("a", "container", "x")]) == [{"a", "c"}, {"b"}]


def test_weak_references_do_not_count(spark):
    assert not together(spark, AB, [("a", "po", "1"), ("b", "po", "1")])


def test_cap_on_a_reference(spark):
    for n, want in ((120, 1), (121, 121)):
        emails = [{"id": f"{k:03}"} for k in range(n)]
        assert len(groups(spark, emails, [(e["id"], "job", "1") for e in emails])) == want


def test_replies(spark):
    assert together(spark, [{"id": "a"}, {"id": "b", "in_reply_to": "<a@example.com>"}])
    assert together(spark, [{"id": "a"}, {"id": "b", "references": "<x@y> <a@example.com>"}])
    assert not together(spark, [{"id": "a"}, {"id": "b", "in_reply_to": "<who@knows>"}])
    assert together(spark, [{"id": "a", "message_id": " plain "}, {"id": "b", "in_reply_to": "plain"}])


def test_of_copies_the_last_gets_the_reply(spark):
    emails = [{"id": "a", "message_id": "<m>"}, {"id": "c", "message_id": "<m>"}, {"id": "b", "in_reply_to": "<m>"}]
    assert groups(spark, emails) == [{"a"}, {"b", "c"}]


def test_blank_message_ids_do_not_join(spark):
    assert not together(spark, [{"id": "a", "message_id": "  "}, {"id": "b", "in_reply_to": "  "}])


def test_subjects(spark):
    same = lambda s: [{"id": "a", "subject_key": s}, {"id": "b", "subject_key": s}]
    assert together(spark, same("twelve chars"))
    assert not together(spark, same("eleven char"))
    assert not together(spark, same("confirmation"))
    assert not together(spark, same(None))
    assert not together(spark, same("twelve chars"), strong_only=True)


def test_cap_on_a_subject(spark):
    for n, want in ((60, 1), (61, 61)):
        assert len(groups(spark, [{"id": f"{k:02}", "subject_key": "a telling subject"} for k in range(n)])) == want


def test_three_rules_chain(spark):
    emails = [{"id": "a"}, {"id": "b", "in_reply_to": "<c@example.com>"}, {"id": "c", "subject_key": "crane to bilbao"}, {"id": "d",
        "subject_key": "crane to bilbao"}]
    assert groups(spark, emails, [("a", "job", "1"), ("b", "job", "1")]) == [{"a", "b", "c", "d"}]


def test_unknown_mails_have_no_say_and_all_others_are_there_once(spark):
    emails = [{"id": f"{k:02}", "in_reply_to": f"<{k - 3:02}@example.com>"} for k in range(30)]
    got = groups(spark, emails, [("zz", "job", "1"), ("00", "job", "1"), ("01", "job", "2")])
    assert len(got) == 3 and sorted(x for g in got for x in g) == [e["id"] for e in emails]


def test_empty(spark):
    assert groups(spark, []) == []


@pytest.mark.parametrize("few", [1 << 18, 3, 0])
def test_components_of_chain_star_and_loop(spark, monkeypatch, few):
    monkeypatch.setattr(components, "LOCAL_EDGES", few)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 150)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(201)} == {0} and {got[1000 + k] for k in range(150)} == {1000} and got[5000] == 5000 and len(got) == 352


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_random_mail_against_union_find(spark, monkeypatch, few):
    monkeypatch.setattr(components, "LOCAL_EDGES", few)
    import random
    from collections import Counter, defaultdict

    rnd = random.Random(5)
    emails = [
        {"id": f"{k:03}", "message_id": rnd.choice([f"<m{k}>", f" <m{k % 40}> ", "", None, f"plain{k}"]), "in_reply_to": rnd.choice([None, None, "",
            f"<m{rnd.randrange(120)}>", f"plain{rnd.randrange(120)}"]),
         "references": rnd.choice([None, f"<m{rnd.randrange(120)}> x <m{rnd.randrange(120)}>"]) if k % 9 == 0 else None,
             "subject_key": rnd.choice(["short", "", f"a long subject {rnd.randrange(60)}", "confirmation"])}
        for k in range(120)
    ]
    keys = [(f"{rnd.randrange(125):03}", rnd.choice(["job", "po", "container"]), f"v{rnd.randrange(90)}") for _ in range(150)]
    end = {e["id"]: e["id"] for e in emails}

    def find(x):
        while end[x] != x:
            x = end[x]
        return x

    def join(group):
        for x in group:
            end[find(x)] = find(group[0])

    of = defaultdict(set)
    for i, kind, value in keys:
        if i in end:
            of[i].add((kind, value))
    shared, subjects, by_message = defaultdict(list), defaultdict(list), {}
    for i, pairs in of.items():
        n = Counter(kind for kind, _ in pairs)
        for kind, value in pairs:
            if kind != "po" and n[kind] == 1:
                shared[kind, value].append(i)
    for e in emails:
        if (e["message_id"] or "").strip():
            by_message[e["message_id"].strip()] = e["id"]
        if len(e["subject_key"]) >= 12 and e["subject_key"] != "confirmation":
            subjects[e["subject_key"]].append(e["id"])
    for group in [*shared.values(), *subjects.values()]:
        join(group)
    for e in emails:
        for header in filter(None, (e["in_reply_to"], e["references"])):
            for name in [p + ">" for p in header.split(">") if "<" in p] or [header]:
                parent = by_message.get(name[name.find("<") if "<" in name else 0 :].strip())
                if parent:
                    join([parent, e["id"]])
    want = defaultdict(set)
    for i in end:
        want[find(i)].add(i)
    assert groups(spark, emails, keys) == sorted(map(frozenset, want.values()), key=sorted)


def test_the_last_copy_is_known_with_null_and_equal_order(spark):
    """Null order comes first; of equals the largest id is meant."""
    same = [{"id": k, "message_id": "<m>", "ingest_order": n} for k, n in (("a", None), ("b", None))]
    reply = {"id": "r", "in_reply_to": "<m>"}
    assert groups(spark, [*same, reply]) == [{"a"}, {"b", "r"}]
    assert groups(spark, [{**same[0], "ingest_order": 5}, {**same[1], "ingest_order": 5}, reply]) == [{"a"}, {"b", "r"}]
    assert groups(spark, [{**same[0], "ingest_order": 0}, same[1], reply]) == [{"a", "r"}, {"b"}]


def test_members_as_lists(spark):
    clusters = spark.createDataFrame([(k, 1 if k < 50 else k) for k in range(53)], "email_id long, cluster_id long")
    got = {(r.cluster_id, r.part): (r.n_members, r.members) for r in members(clusters).collect()}
    assert got == {(1, 0): (50, list(range(50))), (50, 0): (1, [50]), (51, 0): (1, [51]), (52, 0): (1, [52])}
    parts = [r for r in members(clusters, most=8).collect() if r.cluster_id == 1]
    assert len(parts) > 3 and sorted(m for r in parts for m in r.members) == list(range(50)) and all(r.members == sorted(r.members) for r in parts)
