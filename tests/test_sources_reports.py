import json

from pyspark.sql import functions as F

from tessera.operators import reports
from tessera.sources import inlined, retail


def test_inline_postings(spark):
    jobs = [{"title": "Dev", "url": "/j/1", "location": {"name": "Haifa"}, "description": "<p>a</p> b"}, {"name": "QA", "link": "https://jobs.lever.co/x/2", "team": ["R&D"]}, {"title": "Dev again", "url": "/j/1", "city": "x"}, {"title": "Partner", "url": "https://other.example/1", "city": "x"}]
    page = f'<script type="application/json">{json.dumps({"a": [1], "posts": [{"title": "Blog", "url": "/b"}], "jobs": jobs})}</script><script id="__NEXT_DATA__">{{broken</script>'
    rows = spark.createDataFrame([(1, "https://www.acme.io/careers", page), (2, "https://acme.io", None), (3, None, "<p>x</p>")], "page_id int, url string, html string")
    got = sorted((r.page_id, r.title, r.url, r.location, r.description, r.department) for r in inlined.inline_postings(rows).collect())
    assert got == [(1, "Dev", "https://www.acme.io/j/1", "Haifa", "a b", None), (1, "QA", "https://jobs.lever.co/x/2", None, "", "R&D")]


def test_embedded_boards(spark):
    html = r'"https:\/\/jobs.lever.co\/acme\/1" //jobs.lever.co/acme https://boards.greenhouse.io/mentee https://boards.greenhouse.io/acme'
    rows = spark.createDataFrame([(1, html, "acme careers.acme.io"), (2, html, ""), (3, None, None)], "page_id int, html string, hint string")
    got = {(r.page_id, r.place): (r.provider, r.board, r.n) for r in inlined.embedded_boards(rows).collect()}
    assert got == {(1, 1): ("lever", "acme", 2), (1, 2): ("greenhouse", "acme", 1), (2, 1): ("lever", "acme", 2), (2, 2): ("greenhouse", "acme", 1), (2, 3): ("greenhouse", "mentee", 1)}


def test_inline_postings_by_brute_force(spark):
    """Random nested data: the walk over the decoded value, written plainly, against the rows and their expressions."""
    import random
    from urllib.parse import urljoin, urlsplit

    rng = random.Random(5)

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.2:
            return rng.choice(["x", "", 3, None, True])
        if kind < 0.55:
            return [value(depth - 1) if rng.random() < 0.2 else posting(depth - 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice("abcdef"): value(depth - 1) for _ in range(rng.randint(0, 3))}

    def posting(depth):
        x = {"title": rng.choice(["Dev", "QA", "", "Ops"]), "url": rng.choice(["/j/1", "/j/2", "https://jobs.lever.co/a/3", "https://else.example/4", "https://sub.acme.io/5"])}
        if rng.random() < 0.8:
            x[rng.choice(["city", "team", "location"])] = rng.choice(["Haifa", ["R&D"], {"name": "TLV"}])
        if rng.random() < 0.3:
            x["more"] = value(depth)
        return x

    def good(x):
        return isinstance(x, dict) and any(k in x for k in inlined.CONTEXT_KEYS) and inlined.label(x.get("title") or x.get("name")) and x.get("url")

    def walk(x):
        if isinstance(x, list):
            own = [i for i in x if good(i)]
            if len(own) >= max(2, int(0.8 * len(x))):
                return own
            return [p for i in x for p in walk(i)]
        return [p for i in x.values() for p in walk(i)] if isinstance(x, dict) else []

    pages, want = [], set()
    for k in range(150):
        data = {"root": value(4)}
        pages.append((k, "https://www.acme.io/careers", f'<p>x</p><script type="application/json">{json.dumps(data)}</script>'))
        seen = set()
        for p in walk(data):
            url = urljoin("https://www.acme.io/careers", p["url"])
            host = urlsplit(url).netloc
            if url not in seen and (host in ("www.acme.io", "sub.acme.io") or "lever.co" in host):
                seen.add(url)
                want.add((k, p["title"], url))
    got = {(r.page_id, r.title, r.url) for r in inlined.inline_postings(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert got == want and len(want) > 20


def test_object_arrays(spark):
    import time

    text = 'x = [{"a": "]}"}, {"b": [1]}]; y = [1]; z = [ {"c": 1} ]; [{"open": 1'
    assert inlined.object_arrays(text) == ['[{"a": "]}"}, {"b": [1]}]', '[ {"c": 1} ]'] and inlined.object_arrays(None) == []
    got = spark.createDataFrame([(text,), ("[{bad}]",), (None,)], "p string").select(inlined.longest_array("p")).collect()
    assert [r[0] for r in got] == ['[{"a": "]}"}, {"b": [1]}]', None, None]
    began = time.process_time()
    for deep in ('[{"a":' * 20_000, '[{"a": 1}, ' * 20_000, '[{"a":' * 20_000 + "bad" + "}]" * 20_000, '[{"a": 1}, ' * 20_000 + "x" + "]" * 20_000, '["' * 50_000):
        inlined.object_arrays(deep)
    assert inlined.object_arrays('[{"a": bad, "b": [{"c": 1}]}] [{"d": 2}]') == ['[{"c": 1}]', '[{"d": 2}]']
    assert time.process_time() - began < 5


def test_retail(spark):
    payload = json.dumps([["1", "Dev", [["TLV"]]], ["2", "QA", []], ["1", "Dev II", [["Haifa"]]]])
    pages = spark.createDataFrame([(1, payload), (2, json.dumps([["2", "QA II", []]])), (3, "{"), (4, None)], "page int, payload string")
    got = retail.positional(pages, "$", {"id": "$[0]", "title": "$[1]", "city": "$[2][0][0]"}).collect()
    assert {(r.id, r.title, r.city) for r in got} == {("1", "Dev II", "Haifa"), ("2", "QA II", None)}
    html = spark.createDataFrame([(1, '<a href="/j/1"><h2> Dev </h2><i>R&D</i></a>\n<a href="/j/2"><h2>QA</h2></a>')], "page int, html string")
    cards = retail.cards(html, r'<a href="([^"]+)"><h2>([^<]+)</h2>(?:<i>([^<]*)</i>)?', ["url", "title", "team"]).collect()
    assert [(r.url, r.title, r.team) for r in cards] == [("/j/1", "Dev", "R&D"), ("/j/2", "QA", "")]
    listed, details = spark.createDataFrame([("1", "Dev", "a"), ("2", "QA", "b")], "id string, title string, url string"), spark.createDataFrame([("1", None, "text")], "id string, title string, description string")
    both, failed = retail.with_details(listed, details)
    assert [tuple(r) for r in both.collect()] == [("1", "Dev", "a", "text")] and [r.id for r in failed.collect()] == ["2"]
    text = "Acme\n\nacme.io/\nHigh-Tech Company\nBeta Ltd\n \nwww.beta.co.il\nMultinational Corporation\nNo Domain\n\nnothing here\nHigh-Tech Company\n"
    assert [(r["name"], r.domain) for r in retail.directory(spark.createDataFrame([(1, text), (2, None)], "page int, text string")).collect()] == [("Acme", "acme.io"), ("Beta Ltd", "www.beta.co.il")]
    names = spark.createDataFrame([("Acme Labs Ltd. (Formerly X)",), ("Acme",), (None,)], "n string").select(retail.slugs("n")).collect()
    assert [r[0] for r in names] == [["acmelabs", "acme-labs"], ["acme"], []]


def test_slim_and_batch(spark, tmp_path):
    schema = "id string, id_icims string, title string, job_family string, job_category string, job_schedule_type string, locations array<string>, location string, posted_date string, description string, basic_qualifications string, preferred_qualifications string, job_path string"
    rows = spark.createDataFrame([("1", None, "A", "", "Eng", None, ['{"location": "TLV"}', "{bad"], "x", "January  5, 2026", "<p>a</p>", None, "b", "/p"), ("2", "9", "B", "F", "Eng", None, None, "Haifa", "soon", None, None, None, None)], schema)
    got = retail.slim(rows, "https://b").collect()
    assert [(r.id, r.department, r.locations, r.posted_at, r.html, r.url) for r in got] == [("1", "Eng", ["TLV"], "2026-01-05", "<p>a</p>b", "https://b/p"), ("9", "F", ["Haifa"], None, "", None)]
    (tmp_path / "w.json").write_text(json.dumps([{"id": "1", "title": "A", "locations": ["x", "y"], "postedTs": "2026-01-05T00"}, {"id": "2"}]))
    assert [(r.id, r.location, r.posted_at, r.description) for r in retail.batch(spark, str(tmp_path / "w.json")).collect()] == [("1", "x, y", "2026-01-05", "")]


def test_reports(spark):
    companies = spark.createDataFrame([("a", "Acme Ltd", None, None), ("b", "Beta", None, "keep"), ("c", "Cee", None, "skip"), ("d", "Dee", "https://www.dee.io", None), ("e", "Aaa", None, None), ("f", "Acme", "https://dee.io/x", None)], "id string, display_name string, career_url string, review_decision string")
    techmap = spark.createDataFrame([("ACME",), ("Cee",), ("beta",)], "company string")
    assert [r.id for r in reports.needs_review(companies, techmap).collect()] == ["a", "e", "b", "c"]
    assert sorted(r.id for r in reports.to_scrape(companies, techmap).collect()) == ["a", "b", "d", "f"]
    assert {(r.kind, r.key, r.ids) for r in reports.duplicate_keys(companies).collect()} == {("name", "acme", 2), ("host", "dee.io", 2)}
    jobs = spark.createDataFrame([("c", i, "x", "new", d) for i, d in ((1, "Nice. Pays $5,000 a month. More"), (2, None), (3, "no money"), (4, "€ 7 per hour."))], "company_id string, id int, url string, status string, description string")
    assert [(r.id, r.snippet) for r in reports.salary_snippets(jobs).orderBy("id").collect()] == [(1, "Pays $5,000 a month"), (4, "€ 7 per hour")]
    shown = spark.createDataFrame([("Node.js and c++ devs",)], "t string")
    assert shown.select(reports.highlight("t", "node.js C++ x")).first()[0] == "<mark>Node.js</mark> and <mark>c++</mark> devs"
    assert shown.select(reports.highlight("t", "x")).first()[0] == "Node.js and c++ devs"
    found = spark.createDataFrame([("1", "a", "B", 5), ("2", "b", "A", 9), ("3", "a", "B", None)], "id string, company_id string, display_name string, best_score int")
    assert [r.id for r in reports.report_order(found).collect()] == ["2", "1", "3"]
    empty = reports.family_report(spark.createDataFrame([], "id int, title string, family string"))
    assert empty.count() == 0 and reports.run_stats(spark.createDataFrame([], "company_id int, outcome string, new int, closed int")).first().new == 0
    assert reports.highlight(F.col("t"), None) is not None
