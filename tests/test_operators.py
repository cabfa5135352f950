from pyspark.sql import functions as F

from quern.operators import entities, export, facts, pages, policy, scoring
from quern.plans import research


def test_robots(spark):
    body = "User-agent: Bot\nUser-agent: other\nDisallow: /a*b$\nAllow: /a/b\n\nUser-agent: *\nDisallow:\nUser-agent: third\nDisallow: /\n"
    robots = spark.createDataFrame([("o", body)], "origin string, body string")
    targets = spark.createDataFrame([("o", "bot", p) for p in ("/a/b", "/axb", "/axbc", "/robots.txt")] + [("o", "none", "/x"), ("p", "bot", "/x")], "origin string, agent string, path string")
    got = {(r.origin, r.agent, r.path): r.decision for r in policy.robots_decisions(policy.robots_rules(robots), targets).collect()}
    # the empty Disallow closes no group, so `third` and `*` share one
    assert got == {("o", "bot", "/a/b"): "approved", ("o", "bot", "/axb"): "rejected", ("o", "bot", "/axbc"): "approved", ("o", "bot", "/robots.txt"): "approved", ("o", "none", "/x"): "rejected", ("p", "bot", "/x"): "approved"}


def test_source_policy(spark):
    rules = spark.createDataFrame([("blocked", "subdomains", "bad.nl"), ("approved", "exact", "www.good.nl"), ("approved", "subdomains", "x.good.nl"), ("candidate", "exact", "maybe.nl")], "list string, kind string, rule string")
    sources = spark.createDataFrame([(s,) for s in ("https://a.bad.nl/", "good.nl", "y.x.good.nl", "maybe.nl", "other.nl", "localhost")], "source string")
    got = {r.source: (r.decision, r.reason) for r in policy.source_policy(sources, rules).collect()}
    assert got == {
        "https://a.bad.nl/": ("rejected", "blocked"), "good.nl": ("approved", "approved"), "y.x.good.nl": ("approved", "approved"), "maybe.nl": ("manual_review_required", "candidate"),
        "other.nl": ("manual_review_required", "unknown"), "localhost": ("rejected", "malformed"),
    }


def test_terms(spark):
    texts = ["Scraping is prohibited.", "Robots. " + "x " * 200 + "must not", "Welcome.", "Do not use robots"]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", policy.terms_signal(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == ["potential_automated_access_prohibition", "ambiguous_automation_language", "approved", "potential_automated_access_prohibition"]


def test_planned_queries(spark):
    one = spark.range(1).select(research.planned_queries(F.lit("Shopify agency"), F.lit("Netherlands"), F.lit("Amsterdam"), F.lit(".nl")).alias("q")).first()
    assert one.q == ["Shopify agency Netherlands", "Shopify Plus agency Netherlands", "Shopify development company Netherlands", "Shopify ecommerce agency Amsterdam", "site:.nl Shopify agency"]


def test_ranked_pages(spark):
    rows = [("https://a.nl/", f"https://www.a.nl{p}", "", "", [], None, i) for i, p in enumerate(["/", "/contact", "/over-ons", "/diensten/", "/blog", "/oplossingen?x=1"])]
    c = spark.createDataFrame([*rows, ("https://a.nl/", "https://b.nl/about", "", "", [], None, 9)], "homepage_url string, url string, anchor_text string, title string, headings array<string>, navigation_position int, pos long")
    got = [(r.category, r.score) for r in pages.ranked_pages(c, ["blog"], 6).orderBy("rank").collect()]
    assert got == [("homepage", 1400), ("about", 1240), ("services", 1040), ("solutions", 840), ("contact", 440), ("relevant", 210)]


def test_parser_keeps_nested_pages(spark):
    html = "<title>T &amp; x</title><nav><a href='/n'>N</a></nav><div><h1>Head <b>one</b></h1><p>text<script>var a='</p>'</script></div>"
    r = pages.parsed_pages(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert (r[0].title, r[0].headings, r[0].links[0].href, r[0].main_text) == ("T & x", ["Head one"], "/n", "Head one text")
    assert r[1].title == "" and r[1].links == []


def test_parser_reads_titles_as_plain_does(spark):
    # a title cut within a reference, one twice escaped, a tag within a word, a second title
    sources = ["<title>A&amp;&amp</title><h2>B &amp; C&am</h2>", "<title>x &amp;lt; y&nbsp;z</title><h1>Wo<b>rd</b>&quot;</h1>", "<title>one</title><svg><title>two</title></svg><h3>E&#39;s &copy; \u00a0f</h3>"]
    made = spark.createDataFrame(list(enumerate(sources)), "page_id long, html string")
    expected = made.select("page_id", pages.title(F.col("html")).alias("title"), pages.headings(F.col("html")).alias("headings")).orderBy("page_id").collect()
    got = pages.parsed_pages(made).orderBy("page_id")
    assert got.select("page_id", "title", "headings").collect() == expected
    assert [r.title for r in expected] == ["A&&amp", "x &lt; y z", "one"] and got.first().main_text == "B & C&am"


def test_conflict_and_services(spark):
    rows = [("e", 1, "country", "NL", "u1", 0.9), ("e", 2, "country", "Nederland", "u2", 0.89), ("f", 1, "country", "Spain", "u", 0.9), ("f", 2, "country", "France", "u", 0.9), ("e", 3, "services", "Web", "u1", 0.8), ("e", 4, "services", "web ", "u2", 0.7), ("e", 5, "services", "Shop", "u3", 0.9)]
    c = spark.createDataFrame(rows, "entity_id string, pos long, name string, value string, url string, confidence double")
    got = {(r.entity_id, r.name): (r.value, r.confidence, r.conflict) for r in facts.resolved(c.where("name = 'country'")).collect()}
    assert got == {("e", "country"): ("NL", 0.91, False), ("f", "country"): (None, None, True)}
    assert facts.resolved_services(c).first().services == ["Shop", "Web"]


def test_entity_ladder(spark):
    rows = [(1, "Acme BV", "https://acme.nl", None, []), (2, "ACME", "https://www.acme.nl/x", None, []), (3, "Acme", "https://acme.com", None, ["wikidata:Q1"]), (4, "Other", "https://o.com", None, ["wikidata:Q1"]), (5, "Acme", "https://z.com", None, ["wikidata:Q2"])]
    c = spark.createDataFrame(rows, "id long, name string, website_url string, canonical_url string, ids array<string>")
    s = entities.signals(c)
    got = {(r.a, r.b): (r.outcome, r.confidence) for r in entities.decided_pairs(s, entities.candidate_pairs(s)).collect()}
    assert got == {(1, 2): ("merge", 0.99), (1, 3): ("manual_review", 0.94), (2, 3): ("manual_review", 0.94), (3, 4): ("merge", 0.99), (1, 5): ("manual_review", 0.94), (2, 5): ("manual_review", 0.94), (3, 5): ("separate", 0.99)}
    merges = entities.decided_pairs(s, entities.candidate_pairs(s)).where("outcome = 'merge'")
    assert {r.id: r.cluster for r in entities.clusters(c.select("id"), merges).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_large_block_of_entities(spark):
    # the smallest id of the block conflicts with record 2; two ids make every pair of record 0 a review
    for ids in (["wikidata:Q1"], ["wikidata:Q1", "wikidata:Q2"]):
        rows = [(0, "zero", "https://big.nl", None, ids), (2, "two", "https://big.nl", None, ["wikidata:Q2"])] + [(k, f"n{k}", "https://big.nl", None, []) for k in range(3, 602)] + [(700, "Other", "https://else.nl", None, ["wikidata:Q2"])]
        c = spark.createDataFrame(rows, "id long, name string, website_url string, canonical_url string, ids array<string>")
        s = entities.signals(c)
        pairs = entities.candidate_pairs(s)
        assert pairs.where("a <> 700 and b <> 700").count() == 601 * 600 // 2
        decided = entities.decided_pairs(s, pairs).where("outcome = 'merge'")
        assert decided.where("a = 2 and b = 3").count() == 1
        got, whole = ({r.id: r.cluster for r in entities.clusters(c.select("id"), edges).collect()} for edges in (entities.merge_edges(s), decided))
        first = 0 if len(ids) == 1 else 2
        assert got == whole == {0: 0, **{k: first for k in (2, 700, *range(3, 602))}}


def test_similar_names_anywhere(spark):
    import random

    rnd = random.Random(3)
    names = ["".join(rnd.choices("abcdef ", k=rnd.randint(1, 60))).strip() or "a" for _ in range(25)]
    for t in list(names):
        for _ in range(3):
            c = list(t)
            for _ in range(rnd.randint(1, 5)):
                at = rnd.randrange(len(c)) if rnd.random() < 0.5 else 0
                c[at : at + 1] = rnd.choice([[], ["q"], ["q", *c[at : at + 1]]])
                c = c or ["q"]
            names.append("".join(c))
    s = spark.createDataFrame(list(enumerate(names)), "id long, norm_name string")
    every = s.select(F.col("id").alias("a"), F.col("norm_name").alias("x")).join(s.select(F.col("id").alias("b"), F.col("norm_name").alias("y")), F.col("a") < F.col("b"))
    brute = {(r.a, r.b) for r in every.where((entities.text.similarity_percent(F.col("x"), F.col("y")) >= 92) & (F.col("x") != F.col("y"))).collect()}
    assert len(brute) > 10 and {(r.a, r.b) for r in entities.similar_pairs(s).collect()} == brute
    rows = [(1, "qbcdefghij klmnopqr stuvw", "https://a.nl", None, []), (2, "abcdefghij klmnopqr stuvw", "https://b.nl", None, [])]
    s = entities.signals(spark.createDataFrame(rows, "id long, name string, website_url string, canonical_url string, ids array<string>"))
    assert [(r.outcome, r.reason) for r in entities.decided_pairs(s, entities.candidate_pairs(s)).collect()] == [("manual_review", "fuzzy_name")]


def test_pairs_are_made_once_and_judged_where_they_are_made(spark, monkeypatch):
    # slices of three rows; records that share several keys, names that are similar
    monkeypatch.setattr(entities, "SALT_ROWS", 3)
    name = lambda k: ("Northern lights trading company of oslo", "Northern lights trading company of osla", "Northern light trading company of oslo", f"n{k % 4}")[k % 4]
    rows = [(k, name(k), f"https://h{k % 5}.nl" if k % 3 else None, f"https://h{k % 7}.nl" if k % 4 == 0 else None, [f"wikidata:Q{k % 3}"] if k % 5 == 0 else []) for k in range(40)]
    s = entities.signals(spark.createDataFrame(rows, "id long, name string, website_url string, canonical_url string, ids array<string>")).persist()
    every = s.select(F.col("id").alias("a")).join(s.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    whole = {tuple(r) for r in entities.decided_pairs(s, every).where("reason <> 'different'").collect()}
    made = entities.entity_pairs(s)
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len({r[:2] for r in got}) and {r for r in got if r[4] != "different"} == whole
    assert {r[4] for r in whole} >= {"domain", "canonical_domain", "identifier", "exact_name", "fuzzy_name", "conflicting_identifiers"}
    # pairs are neither made distinct nor joined with their records: no exchange is by their ids
    assert "hashpartitioning(a#" not in made._jdf.queryExecution().executedPlan().toString()


def test_scores_add_up(spark):
    facts_ = spark.createDataFrame(
        [("e", 1, "services", "Shopify design", "explicit", 0.9, ["https://e.nl/a"]), ("e", 2, "country", "the Netherlands", "explicit", 0.9, ["https://e.nl/b"]), ("e", 3, "website_url", "https://e.nl/", "explicit", 0.9, ["https://e.nl/"]), ("e", 4, "contact_page_url", "https://e.nl/contact", "explicit", 0.9, ["https://e.nl/"])],
        "entity_id string, pos long, name string, value string, basis string, confidence double, evidence_urls array<string>",
    )
    companies = spark.createDataFrame([("e", "https://www.e.nl")], "entity_id string, website_url string")
    scores = scoring.component_scores(facts_, companies, ["shopify"], "Netherlands", ["country"])
    assert scores.first().asDict() == {"entity_id": "e", "topic": 30, "location": 20, "services": 15, "website": 10, "contact": 10, "evidence": 10, "completeness": 5, "total": 100}
    assert scoring.penalties(scores).count() == 0
    # facts and companies are read once each
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_run_reads_each_page_where_it_lies(spark):
    page = lambda t, body="": f"<title>{t}</title><nav><a href=\"/a\">{t} work</a></nav>{body}"
    rows = [
        (1, "https://good.nl/", page("Good")), (2, "https://www.good.nl/b", page("Good")), (3, "https://bad.nl/", page("Bad")), (4, "https://x.bad.nl/c", page("Bad")), (5, "https://other.nl/directory/x", page("Other")),
        (6, "https://other.nl/login", page("Other")), (7, "https://other.nl/", page("Other", "Solve the CAPTCHA")), (8, "https://other.nl/z", page("Other", "recaptcha, x cf-chl, about")), (9, "no host", page("None")), (10, "https://null.nl/", None),
    ]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([("blocked", "subdomains", "bad.nl")], "list string, kind string, rule string")
    staged = {r.page_id: r.reason for r in research.staged_candidates(p, rules).collect()}
    policy_, site = "policy: blocked", "not an official website"
    assert staged == {1: None, 2: "seen", 3: policy_, 4: policy_, 5: site, 6: "restricted path", 7: "bot challenge", 8: "seen", 9: "policy: malformed", 10: None}
    read = research.readable_pages(p, rules)
    assert {r.page_id for r in read.collect()} == {k for k, why in staged.items() if why in (None, "seen")}
    kept = p.where(F.col("page_id").isin(1, 2, 8, 10))
    assert sorted(map(tuple, facts.read_candidates(read).collect())) == sorted(map(tuple, facts.fact_candidates(kept).collect()))
    # html is read and left: no join gets it; no window deals pages out by site
    todo, joins = [read._jdf.queryExecution().optimizedPlan()], 0
    while todo:
        node = todo.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        assert node.nodeName() != "Window"
        if node.nodeName() == "Join":
            joins += 1
            assert all("html#" not in child.output().mkString(" ") for child in below)
        todo += below
    assert joins == 2


def test_large_field_is_resolved_from_two_keys_a_task(spark):
    rows = [("e", k, "services", f"s{k}", f"u{k}", 0.5 + k / 1000) for k in range(300)] + [("f", k, "country", v, f"u{k}", c) for k, (v, c) in enumerate([("Spain", 0.9), ("spain ", 0.9), ("France", 0.88), ("Italy", 0.1)])]
    rows += [("g", 1, "country", "Spain", "u", 0.9), ("g", 2, "country", "France", "u", 0.87), ("h", 1, "country", "Spain", "u", None), ("h", 2, "country", "France", "u", None), ("i", 1, "country", "Spain", "u", 0.9), ("i", 2, "country", "France", "u", None)]
    c = spark.createDataFrame(rows, "entity_id string, pos long, name string, value string, url string, confidence double")
    made = facts.resolved(c)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert {r.entity_id: tuple(r)[2:] for r in made.collect()} == {
        "e": (None, None, 0, True), "f": (None, None, 0, True), "g": ("Spain", 0.9, 1, False), "h": (None, None, 0, None), "i": ("Spain", 0.9, 1, False),
    }
    # no window has all candidates of a field, and that over its keys is cut before they are dealt out
    assert plan.count("Window [") == 1 and plan.count("WindowGroupLimit") == 2


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([("=x", 1)], "a string, b int")
    assert export.export(spark, rows, "csv", f"file://{tmp_path}/out") == {"format": "csv", "location": f"file://{tmp_path}/out", "count": 1}
    assert spark.read.csv(f"file://{tmp_path}/out", header=True).first().a == "'=x"
