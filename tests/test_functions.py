"""Column functions, policies, rules, threads and packs against plain Python."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.config import ConfigError, dotted, load_config, model_for, state_path
from postmill.functions import privacy, text
from postmill.functions.mime import address_list, decoded, iso_date
from postmill.functions.privacy import Security
from postmill.limits import MB, PackLimits, check_limits, resolve_limits
from postmill.operators import packs, state, taxonomy, threads
from postmill.operators.rules import Assignment, Rule, first_match


def values(spark, column, rows, schema="x string"):
    frame = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"_i int, {schema}")
    return [r[0] for r in sorted(((r.v, r._i) for r in frame.select("_i", column.alias("v")).collect()), key=lambda r: r[1])]


X = None  # the column x; columns need a session


@pytest.fixture(autouse=True)
def _column(spark):
    global X
    X = F.col("x")


def test_slug_and_paths(spark):
    given_ = ["A & B", "  Über Café!", "", "---", "x" * 200, "a" * 159 + " b", None]
    assert values(spark, text.slug(X), given_) == [
        "a-and-b", "ber-caf", "untitled", "untitled", "x" * 160, "a" * 159, "untitled"]
    assert values(spark, text.category_path(X), ["A & B/c\\ D//", " / ", "", "x"]) == ["a-and-b/c/d", "general", "general", "x"]
    assert values(spark, text.display_name(X), ["a/big-news", "q/1st-4th-x2y", "one"]) == ["Big News", "1St 4Th X2Y", "One"]
    assert values(spark, text.parent_path(X), ["a/b/c", "a"]) == ["a/b", None]
    assert values(spark, text.category_directory(F.lit("out"), X, F.lit("2024")), ["A/B"]) == ["out/a/b/2024"]
    assert values(spark, text.category_directory(F.lit("out"), X), ["A/B"]) == ["out/a/b"]
    assert values(spark, text.pack_filename(X, F.lit("2024"), F.lit(7)), ["A/B", "z" * 170]) == ["a-b-2024-007.md", "z" * 160 + ".md"]
    assert values(spark, text.label_name(X), ["Big News"]) == ["big-news"]
    assert values(spark, text.split_labels(X), [" a, ,b ", None, ""]) == [["a", "b"], [], []]


def test_filenames(spark):
    got = values(spark, text.safe_filename(X, F.lit(3)), ["a b(1).pdf", "..__", None, "ü" * 140 + ".txt", "y" * 140, "é__x.tar.gz", "w" * 140 + ".averylongextension"])
    assert got == ["a_b_1_.pdf", "attachment-3", "attachment-3", "ü" * 120 + ".txt", "y" * 120, "é_x.tar.gz", "w" * 120]
    got = values(spark, text.attachment_path(F.lit("f"), F.lit("me"), F.lit("2024-01-01"), X, F.lit("a b")), ["<M@x>", None])
    assert got == ["f/me/2024/m-x/a_b", "f/me/2024/unknown/a_b"]


def test_subjects_dates_bodies(spark):
    assert values(spark, text.subject_root(X), ["Re: Re: x", " FWD:re :FW: y ", "Report: z", "", "re:"]) == ["x", "y", "Report: z", "", ""]
    assert values(spark, text.date_band(X), ["2024-05-01", "", None, "24"]) == ["2024", "undated", "undated", "24"]
    html = "<style>a{}</style><p>Hi<br/>there &amp; <b>you</b></p>\n\n\n\n<script x>1<2</script>end "
    assert values(spark, text.html_to_text(X), [html]) == ["Hi\nthere &amp; you \n\nend"]
    assert values(spark, text.word_count(X), ["a b　c\n", "", None]) == [3, 0, 0]
    assert values(spark, text.body_hash(X), ["", None]) == [None, None]
    row = ("s", None, "", "m", " b \n")
    assert values(spark, text.render_message(*[F.col(c) for c in "abcde"]), [row, (None,) * 5], "a string, b string, c string, d string, e string") == [
        "---\nsubject: s\nmessage_id: m\n---\n\nb\n", "---\n---\n\n*(no body)*\n"]
    keys = [(" a  b", "p", "m"), ("", " p ", "m"), (None, "", "m"), (None, None, " ")]
    assert values(spark, text.thread_key(*[F.col(c) for c in "abc"]), keys, "a string, b string, c string") == ["a", "p", "m", None]
    head = text.pack_header(F.lit("me"), X, F.lit("c"), F.lit("b"), F.lit(1), F.lit(2), F.lit("now"), F.lit("db"))
    got = values(spark, head, ["e", None])
    assert got[0].split("\n")[1:3] == ["account: me", "account_email: e"] and got[1].split("\n")[2] == "" and got[0].endswith("\n\n---\n\n")


PII = ["a.b@c.org and (555) 867-5309", "+1 555-867-5309", "123-45-6789 123 45 6789", "1234 5678 9012 3456 1234-5678-9012-3456",
       "15558675309", "none", "é123-45-6789", "x" * 90 + "@" + "y" * 60 + ".com"]


def test_findings_and_scrub(spark):
    patterns = [(k, re.compile(p), m) for k, p, m in privacy.PATTERNS]
    got = values(spark, privacy.findings(X), PII)
    for body, found in zip(PII, got, strict=True):
        want = [(k, p.findall(body)) for k, p, _ in patterns if p.search(body)]
        assert [(f.finding_type, f.excerpt, f["count"]) for f in found] == [(k, m[0][:100], len(m)) for k, m in want]
    for flags in [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 1), (1, 1, 1, 1), (0, 0, 0, 0)]:
        want = []
        for body in PII:
            for (_, p, mark), on in zip(patterns, flags, strict=True):
                body = p.sub(mark, body) if on else body
            want.append(body)
        security = Security("raw", True, True, *map(bool, flags))
        assert values(spark, privacy.scrub(X, security), PII) == want


def test_policy(spark):
    assert values(spark, privacy.export_profile(X, "scrubbed"), ["raw", "odd", None, "", "exclude"]) == ["raw", "scrubbed", "scrubbed", "scrubbed", "exclude"]
    assert values(spark, privacy.export_profile(X, None), [None]) == ["raw"]
    on = Security.of({"security": {"redact_email_addresses": True, "other": 1}})
    body, changed = privacy.apply_policy(F.col("b"), F.col("p"), on)
    rows = [("a@b.org", "scrubbed"), (None, "reviewed"), ("a@b.org", "raw"), ("t", "metadata-only"), ("t", "scrubbed")]
    got = values(spark, F.struct(body.alias("b"), changed.alias("c")), rows, "b string, p string")
    assert [tuple(g) for g in got] == [("[EMAIL REDACTED]", True), ("", False), ("a@b.org", False), (None, False), ("t", False)]
    off, _ = privacy.apply_policy(F.col("b"), F.col("p"), Security(scrub_enabled=False, redact_email_addresses=True))
    assert values(spark, off, [("a@b.org", "scrubbed"), ("t", "metadata-only")], "b string, p string") == ["a@b.org", None]


def test_rules(spark):
    rules = [Rule.of(x) for x in (
        {"name": "no outcome", "match": {"subject_contains": ["hello"]}},
        {"name": "empty", "match": {}, "assign": {"category_path": "x"}},
        {"name": "hint", "match": {"from_contains": "boss@"}, "assign_hint": {"category_path": "Work/Boss"}},
        {"name": "both", "match": {"from_domain": ["X.org"], "subject_contains": ["HELLO"]}, "assign": {"category_path": "A"}, "assign_hint": {"category_path": "B"}},
        {"name": "bare", "match": {"subject_contains": ["zzz"]}, "assign": {"sensitivity": "high"}},
    )]
    outcome = first_match(rules, F.col("s"), F.col("r"), F.col("t"))
    rows = [("Boss@x.org", [], "hello"), ("a@x.org", None, None), (None, ["b@X.ORG"], ""), ("a@y.org", [], "say Hello"), ("a@sub.x.org", [], None), ("a", [], "zzz")]
    got = values(spark, outcome, rows, "s string, r array<string>, t string")
    assert [g and (g.rule, g.classifier_type, g.confidence, g.category_path) for g in got] == [
        ("hint", "rule_hint", 0.75, "work/boss"), ("both", "rule", 1.0, "a"), ("both", "rule", 1.0, "a"), ("both", "rule", 1.0, "a"), None,
        ("bare", "rule", 1.0, None)]
    assert values(spark, first_match([], F.col("s"), F.col("r"), F.col("t")), rows[:1], "s string, r array<string>, t string") == [None]
    assert Rule("n", assign_hint=Assignment("c")).outcome() is not None


def test_threads(spark):
    schema = "id long, account_key string, thread_key string, sender string, recipients array<string>, subject string, body_text string, date_utc string"
    rows = [(9, "a", "t", "Z@x", ["B@x"], " ", "  ", None), (1, "a", "t", "a@x", [], "Re: S", "one", "2024-01-02"),
            (2, "a", "t", None, ["z@x"], "T", "two" * 300, "2024-01-01"), (3, "b", "t", "c@x", None, None, None, None),
            *[(10 + k, "a", "u", "u@x", [], "s", f"body {k}", f"2024-02-{k + 1:02}") for k in range(8)], (50, "a", None, "x", [], "s", "b", None)]
    frame = spark.createDataFrame(rows, schema)
    got = {(r.account_key, r.thread_key): r for r in threads.thread_inputs(frame, ["account_key", "thread_key"]).collect()}
    one = got["a", "t"]
    assert (one.subject, one.sender, one.message_count, one.date_min, one.date_max) == ("T", "", 3, "2024-01-01", "2024-01-02")
    assert one.participants == ["a@x", "b@x", "z@x"] == one.recipients and one.excerpts == [("two" * 300)[:500], "one"]
    assert got["a", "u"].excerpts == ["body 0", "body 4", "body 6", "body 7"]
    assert got["b", "t"].excerpts == [] and got["b", "t"].subject == "" and len(got) == 3
    table = {r.thread_key: r for r in threads.thread_table(frame.filter("account_key = 'a'"), ["account_key", "thread_key"]).collect()}
    assert table["t"].subject == "Re: S" and table["t"].participants == ["a@x"] and len(table) == 2


def plain_packs(sizes, limits):
    out, words, data, n, pack = [], 0, 0, 0, 1
    for w, b in sizes:
        if n and (words + w > limits.max_words_per_source or data + b > limits.max_bytes_per_source or n + 1 > limits.max_messages_per_source
                  or words >= limits.target_words_per_source or data >= limits.target_bytes_per_source):
            words, data, n, pack = 0, 0, 0, pack + 1
        words, data, n = words + w, data + b, n + 1
        out.append(pack)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 30)), min_size=1, max_size=50), st.integers(5, 40), st.integers(3, 40),
       st.integers(20, 90), st.integers(10, 90), st.integers(1, 9))
def test_next_starts(sizes, a, b, c, d, e):
    import numpy as np

    limits = PackLimits("t", 9, 0, 9, a, b, c, d, e)
    jump = packs.next_starts(np.array([s[0] for s in sizes]), np.array([s[1] for s in sizes]), limits)
    i, pack, got = 0, 1, []
    while i < len(sizes):
        got += [pack] * (int(jump[i]) - i)
        i, pack = int(jump[i]), pack + 1
    assert got == plain_packs(sizes, limits)


def test_packs_across_chunks(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), i, "c", rng.choice([None, "2024-01-0" + str(rng.randrange(1, 10))]), "me", "c", "2024", rng.randrange(0, 12), rng.randrange(1, 30))
            for i in range(400)]
    frame = spark.createDataFrame(rows, "_source int, id long, category_path string, date_utc string, account_key string, category string, band string, chunk_words long, chunk_bytes long")
    frame = frame.withColumns({"thread_key": F.lit("t"), "was_scrubbed": F.lit(False)})
    limits = PackLimits("t", 9, 0, 9, 40, 30, 100, 90, 7)
    got = {r.id: r.pack for r in packs.assign_packs(frame, limits, chunk=20).collect()}
    order = sorted(rows, key=lambda r: (r[0], r[3] is None, r[3] or "", r[1]))
    assert [got[r[1]] for r in order] == plain_packs([r[7:] for r in order], limits)
    assert packs.assign_packs(frame.limit(0), limits).count() == 0


def test_state(spark, tmp_path):
    store = state.StateStore(spark, str(tmp_path))
    assert store.read("t", "a int").count() == 0 and store.tables() == []
    for n in range(4):
        store.write("t", store.read("t", "a int").unionByName(spark.createDataFrame([(n,)], "a int")))
    assert sorted(r.a for r in store.read("t", "a int").collect()) == [0, 1, 2, 3] and store.versions() == [3, 4]
    for n in range(4, 20):  # appends write new rows only; parts of one size are merged
        store.append("t", spark.createDataFrame([(n,)], "a int"))
    assert sorted(r.a for r in store.read("t", "a int").collect()) == list(range(20)) and len(store.current()["t"]) < 8
    assert len([p for p in (tmp_path / "t").iterdir()]) <= len({p for v in store.versions() for p in store.manifest(v)["t"]})
    assert [r.b for r in store.read("t", "a int, b string").filter("a = 3").collect()] == [None]
    with pytest.raises(ValueError, match="crash"), store.change() as made:  # nothing of a broken change is seen
        made.replace("t", spark.createDataFrame([(-1,)], "a int"))
        made.append("u", spark.createDataFrame([(1,)], "a int"))
        raise ValueError("crash")
    assert store.read("t", "a int").count() == 20 and store.tables() == ["t"]
    with pytest.raises(RuntimeError, match="came first"), store.change() as late:
        late.append("t", spark.createDataFrame([(20,)], "a int"))
        store.append("t", spark.createDataFrame([(21,)], "a int"))
    assert {r.a for r in store.read("t", "a int").collect()} == {*range(20), 21}
    rows = spark.createDataFrame([("s", 1, "running", 5), ("s", 2, "completed", 9), ("t", 3, "interrupted", 2)], "source_id string, id int, status string, last_mbox_key long")
    assert {(r.source_id, r.last_mbox_key) for r in state.resume_points(rows).collect()} == {("s", 5), ("t", 2)}


def test_taxonomy(spark):
    rows = taxonomy.category_rows(spark, [{"path": "A/B c"}, {"path": "a/b-c", "locked": True}, {"path": "z"}], None)
    assert {(r.path, r.display_name, r.parent_path) for r in rows.collect()} == {("a/b-c", "B C", "a"), ("z", "Z", None)}
    assert taxonomy.seed(rows, rows).count() == 0
    assert taxonomy.seed(rows, taxonomy.category_rows(spark, [{"path": "z"}], "me")).count() == 1
    both = rows.unionByName(taxonomy.category_rows(spark, [{"path": "z"}], "me"))
    assert [taxonomy.visible(both, *a).count() for a in (("me",), ("me", False), (None,), ("x",))] == [3, 1, 3, 2]


def test_address_lists():
    """A comma separates exactly if the quotes after it pair up, also where quotes are unbalanced."""
    from email.utils import parseaddr

    def plain(text):
        cuts = [i for i, ch in enumerate(text) if ch == "," and text[i:].count('"') % 2 == 0]
        parts = [text[a + 1:b] for a, b in zip([-1, *cuts], [*cuts, len(text)], strict=True)]
        return [x for x in (parseaddr(p.strip())[1].lower() for p in parts) if x]

    rng = random.Random(3)
    assert address_list('"Bo, Jr" <Bo@x>, a@y,, <c@z>') == ["bo@x", "a@y", "c@z"] and address_list("") == []
    for _ in range(300):
        text = "".join(rng.choice(['"', ",", "a@b", " ", "<c@d>", "n"]) for _ in range(rng.randrange(12)))
        assert address_list(text) == plain(text)


def test_mail_headers():
    assert decoded("=?utf-8?q?Gr=C3=BC?= =?latin-1?q?=DFe?=") == "Grü ße" and decoded("=?nope?q?=E9?=") == "é" and decoded(None) == ""
    assert address_list('"A, B" <A@x>, , c@Y, broken') == ["a@x", "c@y", "broken"]
    assert iso_date("Mon, 01 Jan 2024 10:00:00 -0000") == "2024-01-01T10:00:00" and iso_date("nope") is None and iso_date("") is None


def test_limits_and_config(tmp_path):
    profile = {f: 10 for f in PackLimits.__dataclass_fields__ if f != "profile_name"} | {"max_sources": 600, "reserved_sources": 100}
    config = {"exports": {"notebooklm": {"profiles": {"ultra_safe": profile, "bad": {"max_sources": 1}}}}}
    limits = resolve_limits(config, max_words=7, max_mb=2, target_sources=None)
    assert (limits.budget, limits.max_words_per_source, limits.max_bytes_per_source) == (500, 7, 2 * MB)
    for name in ("none", "bad"):
        with pytest.raises(ConfigError):
            resolve_limits(config, name)
    for wrong in ({"max_sources": 0}, {"reserved_sources": -1}, {"max_sources": 5}, {"max_mb": 201}):
        with pytest.raises(ConfigError):
            check_limits(resolve_limits(config, **wrong))
    assert check_limits(resolve_limits(config, max_mb=201), force=True) == []
    assert len(check_limits(resolve_limits(config, max_words=600_000, target_words=700_000, target_mb=9, target_sources=900))) == 4
    assert dotted({"a": {"b": 1}}, "a.b") == 1 and dotted({"a": 1}, "a.b", 2) == 2
    file = tmp_path / "c.yaml"
    file.write_text("a: 1\n")
    assert load_config(str(file)) == {"a": 1}
    file.write_text("- 1\n")
    with pytest.raises(ConfigError):
        load_config(str(file))
    with pytest.raises(ConfigError):
        load_config(str(tmp_path / "none.yaml"))
    assert state_path({}, "x") == "x" and state_path({"paths": {"database": "y"}}) == "y" and state_path({}) == "var/postmill"
    models = {"classification": {"ollama": {"models": {"r": "m"}, "default_model": "d"}}}
    assert [model_for(models, *a) for a in (("r",), ("q",), ("r", "cli"))] == ["m", "d", "cli"]
    with pytest.raises(ConfigError):
        model_for({}, "r")


def test_sql_functions(spark):
    from postmill.functions import sql

    assert "slugify" in sql.register(spark)
    rows = ["A & B", " x ", "", "A/B\\ c//", "<p>a<br>b</p>\n\n\n\n<style>x</style> c", "a@b.org 555-867-5309 123-45-6789", "2024-01-02", None]
    full = Security("raw", True, True, True, True, True, True)
    pairs = {"slugify": text.slug(X), "category_path": text.category_path(X), "html_to_text": text.html_to_text(X),
             "scrub_text": privacy.scrub(X, full), "date_band": text.date_band(X)}
    for name, column in pairs.items():
        assert values(spark, F.expr(f"{name}(x)"), rows) == values(spark, column, rows), name


def test_sample_configuration():
    from pathlib import Path

    from postmill.archive import rules_of

    config = load_config(str(Path(__file__).parents[1] / "config/postmill.yaml"))
    limits = resolve_limits(config)
    assert (limits.profile_name, limits.budget, limits.max_words_per_source) == ("ultra_safe", 500, 350_000)
    assert {n: resolve_limits(config, n).budget for n in ("standard", "plus", "pro", "ultra")} == {"standard": 40, "plus": 80, "pro": 250, "ultra": 525}
    assert check_limits(limits) == [] and [r.name for r in rules_of(config)] == ["newsletters", "bills"]
