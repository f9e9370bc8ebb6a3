"""The match of stores and customers against a plain run of the list, with conflicts and crowds."""

import random
import re

from retail_lens.functions.text import STORE_WORDS
from retail_lens.operators import matching
from retail_lens.plans.facts import facts

S = "store_id long, domain string, name string, phones array<string>, state string, postal string"
C = "seq long, domain string, phone string, name string, state string, postal string"


def compact(s):
    return re.sub("[^a-z0-9]", "", (s or "").lower())


def core(s):
    return "".join(w for w in re.findall("[a-z0-9]+", (s or "").lower()) if w not in STORE_WORDS) or compact(s)


def digits(s):
    return re.sub("[^0-9]", "", s or "")[-10:]


def plain(stores, customers, domain_core=lambda d: compact(d.split(".")[0])):
    out = {}
    for i, domain, name, phones, state, postal in stores:
        def found(domain=domain, name=name, phones=phones, state=state, postal=postal):
            for c in sorted(customers):
                if c[1] and c[1] == domain:
                    return c[0], "domain"
            wanted = {digits(p) for p in phones or [] if len(digits(p)) == 10}
            for c in sorted(customers):
                if digits(c[2]) in wanted:
                    return c[0], "phone"
            label = core(name) if (name or "").strip() else domain_core(domain or "")
            if len(label) < 4:
                return None
            for c in sorted(customers):
                other = core(c[3])
                if len(other) < 4 or (state and c[4] and state != c[4]) or (postal and c[5] and postal[:5] != c[5][:5]):
                    continue
                if other == label:
                    return c[0], "name"
                if len(other) >= 6 and (other in label or label in other) and state and state == c[4]:
                    return c[0], "name+state"
            return None
        if found():
            out[i] = found()
    return out


def held(spark, stores, customers):
    got = matching.match(spark.createDataFrame(stores, S), spark.createDataFrame(customers, C))
    assert {r.store_id: (r.seq, r.how) for r in got.collect()} == plain(stores, customers)
    return got


def test_tiers_conflicts_and_contained_names(spark):
    customers = [
        (1, "cedar.com", None, "Cedar & Hyde", "TN", "37203"), (2, "", "+1 (615) 555-0101", "Nobody", None, None), (3, None, "", "The Martins Shop", "NY", "10001"), (4, "", "", "Martins", "", ""), (5, "", "", "Aldo Martins", "CA", "90210-1234"),
        (6, "", "", "Lyla", "CA", ""), (7, "", "555-0101", "Blue", "CA", ""), (8, "", "", "abc", "CA", ""), (9, "", "", "The Shop", "CA", ""), (10, "", "", "Ivory Coastline", None, "33101"), (11, "cedar.com", "", "Second", "", ""), (12, "", "", None, "CA", None),
    ]
    stores = [
        (1, "cedar.com", "x", [], "", ""), (2, "a.com", "Nothing", ["615.555.0101", "1"], "", ""), (3, "b.com", "Aldo Martins", None, "NY", "10001"), (4, "c.com", "Aldo Martins", None, "CA", "90210"), (5, "d.com", "Martins", [], None, None), (6, "e.com", "Martins", [], "CA", "11111"),
        (7, "martins.com", "", [], "NY", ""), (8, "f.com", "Aldo Martins", [], "TX", ""), (9, "g.com", "Lylastore here", [], "CA", ""), (10, "h.com", "Lyla", [], "CA", ""), (11, "i.com", "abc", [], "CA", ""), (12, "j.com", "Shop", [], "CA", ""), (13, "k.com", "Ivory Coastline", [], "FL", "33101"),
        (14, "k.com", "Ivory Coastline", [], "FL", "33102"), (15, None, None, None, None, None), (16, "", " ", ["", None], "CA", ""), (17, "l.com", "tins", [], "NY", "10001"), (18, "m.com", "martins", [], "NY", "10001-77"),
    ]
    held(spark, stores, customers)
    held(spark, stores, [])
    held(spark, [], customers)


def test_random_names_in_few_places(spark):
    rng = random.Random(9)
    parts = ["an", "ber", "co", "del", "el", "fa", "gor"]
    name = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
    place = lambda: (rng.choice(["NY", "CA", "", None]), rng.choice(["10001", "10002-5", "", None]))
    customers = [(i, "", "", name(), *place()) for i in range(150)] + [(500 + i, "", "", "delber", "NY", "10001") for i in range(50)]
    stores = [(i, f"{name()}.com", rng.choice([name(), name(), ""]), [], *place()) for i in range(150)]
    assert len(held(spark, stores, customers).collect()) > 15


def test_contained_names_are_found_by_keys_alone(spark):
    needles = spark.createDataFrame([("a", x) for x in ("abcdef", "bcdefg", "zzzzzz", "short")] + [("b", "abcdef")], "k string, needle string")
    hay = spark.createDataFrame([("a", "xxabcdefgxx"), ("a", "abcdef"), ("a", "xbcdefx"), ("b", "nothing"), ("a", "zzzzz")], "k string, haystack string")
    found = matching.contained(needles, hay, ["k"], 6)
    assert sorted(tuple(r) for r in found.collect()) == [("a", "abcdef", "abcdef"), ("a", "abcdef", "xxabcdefgxx"), ("a", "bcdefg", "xxabcdefgxx")]
    f = facts(found)
    assert f.products == 0 and f.python == 0


def test_no_side_of_the_match_goes_through_the_driver(spark):
    stores, customers = spark.createDataFrame([(1, "a.com", "Martins", ["615 555 0101"], "NY", "10001")], S), spark.createDataFrame([(1, "a.com", "615 555 0101", "Martins", "NY", "10001")], C)
    plan = matching.match(stores, customers)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
