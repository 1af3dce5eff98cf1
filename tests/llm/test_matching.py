from tributary.llm.matching import match, profiles, with_confidence

P = "id string, email string, first string, last string, phone string, rule string"


def pairs(spark, a, b):
    frames = [profiles(spark.createDataFrame([(*r, "x") for r in rows], P)) for rows in (a, b)]
    return match(*frames)


def found(spark, a, b):
    return sorted((r.a_id, r.b_id) for r in pairs(spark, a, b).collect())


A = [
    ("1", "Jim.Lee12345@x.example", "James", "Lee", "+1 (555) 123-4567"),
    ("1", None, "James", "Lee", None),
    ("2", None, "Anna", "Lee", "15551234567"),  # household of 1
    ("3", "kim99881@x.example", "Kim", "Ode", None),
    ("4", "sam77777@x.example", "Sam", "Ode", "5550001111"),
    ("5", "other55555@x.example", "James", "Lee", "5559998888"),  # namesake
    ("6", None, None, None, None),
    (None, "jim.lee12345@x.example", "James", "Lee", None),
]


def test_rules(spark):
    b = [
        ("m1", "jim.lee12345+news@x.example", "Jim", "Lee", None),
        ("m2", "kim99881@y.example", None, None, None),
        ("m3", None, "Ode", "Samuel", "555-000-1111 x7"),
        ("m4", "z@z.example", None, None, None),
        ("m5", None, "A.", "Lee", "0015551234567"),
    ]
    assert found(spark, A, b) == [("1", "m1"), ("2", "m5"), ("3", "m2"), ("4", "m3")]


def test_two_ids_carry_over(spark):
    a = [("1", "q11111@x.example", "Eva", "Moor", "5551112222"), ("2", None, "Eva", "Moor", "5551112222")]
    assert found(spark, a, [("m", "q11111@x.example", "Eva", "Moor", None)]) == [("1", "m"), ("2", "m")]


def test_shared_counter_ties_nobody_by_name(spark):
    a = [(str(i), "counter@shop.example", f"n{chr(97 + i)}", f"last{chr(97 + i)}", None) for i in range(20)]
    b = [("m", "counter@shop.example", "Zed", "Other", None)]
    assert found(spark, a, b) == []


def test_confidence_and_empty(spark):
    got = pairs(spark, A, [("m1", "jim.lee12345@x.example", "Jim", "Lee", None)])
    labels = spark.createDataFrame([("a", "1", "u"), ("b", "m1", "u"), ("b", "m1", None)], "side string, id string, entity string")
    r = with_confidence(got, labels).collect()
    assert [(x.a_id, x.b_id, round(x.confidence, 4)) for x in r] == [("1", "m1", round((1 + 3.6) / 5, 4))]
    assert with_confidence(got, labels.limit(0)).first().confidence == 0.9
    assert found(spark, [], []) == []


def crowd(n, side):
    """Profiles of one busy e-mail, phone and number, with slipped, swapped, short, hidden and missing names."""
    import random

    r = random.Random(f"{side}{n}")
    firsts, lasts = ["James", "Jim", "Jmaes", "J.", "Jame", "Lee", "Ann", "Anna", "Zoe", "Oez", "Samuel", "Sam", None], ["Lee", "Leee", "Moor", "Room", "Orom", "James", "Ode-Moor", "Li", None]
    mails = ["desk@x.example", "lee@x.example", "12345@x.example", "jlee12345@x.example", "jlee12345@y.example", "jleee12345@x.example", "jle12345@x.exampl", "sam.moor12345@x.example", None]
    return [(f"{side}{i}", r.choice(mails), r.choice(firsts), r.choice(lasts), r.choice(["5551112222", None])) for i in range(n)]


def test_hot_contacts_lose_no_pair(spark):
    from tributary.llm.matching import cascade, persons

    a, b = (profiles(spark.createDataFrame([(*r, "x") for r in crowd(110, s)], P)).cache() for s in "ab")
    split, whole = ({tuple(r) for r in cascade(a, b, hot_pairs=n).collect()} for n in (0, 10**9))
    assert split == whole and len(whole) > 200

    def groups(hot_pairs):
        by = {}
        for r in persons(a, hot_pairs)[0].collect():
            by.setdefault(r.person, set()).add(r.id)
        return sorted(map(sorted, by.values()))

    assert groups(0) == groups(10**9)


def test_persons_against_all_pairs(spark):
    """Ids that share a contact and agree in names are one person, over any chain; persons resolved by a pass meet no
    other resolved person, so each pass has fewer rows to join."""
    from itertools import combinations

    from tributary.llm.matching import persons

    def near(x, y):
        if x == y:
            return True
        if min(len(x), len(y)) < 3:
            return False
        slips = {x[:i] + x[i + 1 :] for i in range(len(x))}, {y[:i] + y[i + 1 :] for i in range(len(y))}
        swap = any(x[:i] + x[i + 1] + x[i] + x[i + 2 :] == y for i in range(len(x) - 1))
        return y in slips[0] or x in slips[1] or (len(x) == len(y) and (bool(slips[0] & slips[1] and sum(p != q for p, q in zip(x, y)) == 1) or swap))

    names = [("Anna", "Moor"), ("Anna", "Moro"), ("Ana", "Moor"), ("Zoe", "Moor"), ("Zoe", "Lindt"), ("Zed", "Lind")]
    rows = [(f"a{i}", f"box{i % 7}@x.example", *names[i * 5 % 6], f"55511100{i % 5:02d}") for i in range(40)] + [("a99", None, None, None, None)]
    frame = profiles(spark.createDataFrame([(*r, "x") for r in rows], P))
    got = {}
    for r in persons(frame)[0].collect():
        got.setdefault(r.person, set()).add(r.id)
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r, s in combinations(rows[:-1], 2):
        if (r[1] == s[1] or r[4] == s[4]) and near(r[2].lower(), s[2].lower()) and near(r[3].lower(), s[3].lower()):
            parent[find(r[0])] = find(s[0])
    want = {}
    for i in parent:
        want.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_slip_in_an_address_without_number(spark):
    a = [("1", "marten.vandyke@x.example", "Marten", "Vandyke", None), ("2", "marten.vandyke@y.example", "Marten", "Vandyke", None)]
    b = [("m", "martn.vandyke@x.example", "Marten", "Vandyke", None), ("n", "marten.vandyke@z.test", "Marten", "Vandyke", None)]
    assert found(spark, a, b) == [("1", "m")]


def test_busy_phone_and_mailbox_keep_their_people(spark):
    names = [(c * 3 + d * 3, d * 3 + c * 4) for c in "abcdefgh" for d in "klmnop"]
    a = [(str(i), "desk@shop.example" if i % 2 else None, f, n, "5551112222") for i, (f, n) in enumerate(names)]
    b = [(f"m{i}", "desk@shop.example" if i % 2 else None, f, n, "555-111-2222") for i, (f, n) in enumerate(names)]
    got = set(found(spark, a, b))
    assert {(str(i), f"m{i}") for i in range(len(names))} == got


def test_chain_of_ids_carries_over(spark):
    a = [("1", "q11111@x.example", "Eva", "Moor", None), ("2", "q11111@x.example", "Eva", "Moor", "5551112222"), ("3", None, "Eva", "Moor", "5551112222"), ("3", "r22222@x.example", "Eva", "Moor", None), ("4", "r22222@x.example", "Eva", "Moor", None)]
    b = [("m", None, "Eva", "Moor", "5553334444"), ("n", "s33333@x.example", "Eva", "Moor", "5553334444"), ("o", "s33333@x.example", "Eva", "Moor", None), ("o", "q11111@x.example", "Eva", "Moor", None)]
    assert found(spark, a, b) == [(i, j) for i in "1234" for j in "mno"]


def test_rules_stay_small_plans(spark):
    """The planner walks a pass's rules many times, and the driver's memory goes with their size."""
    from tributary.llm.matching import PASSES, WITHIN, _resolved, _side, name_columns

    p = profiles(spark.createDataFrame([], P)).selectExpr("*", "'' as key", "false as done")
    pairs = _side(p, "a").join(_side(p, "b"), "key")
    bare = len(pairs._jdf.queryExecution().analyzed().toString())
    for _, rules in [*PASSES, *WITHIN]:
        assert len(_resolved(pairs, rules, name_columns())._jdf.queryExecution().analyzed().toString()) - bare < 15_000
