"""Mailbox to export, end to end, on own mailboxes."""

import csv
import json
import mailbox
from email.message import EmailMessage
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postmill.archive import AccountError, Archive
from postmill.limits import UNLIMITED, PackLimits
from postmill.sources.mbox import read_mbox

CONFIG = {
    "security": {"default_export_profile": "scrubbed", "redact_email_addresses": True, "redact_ssn_like_numbers": True,
                 "redact_credit_card_like_numbers": True, "redact_phone_numbers": True},
    "classification": {"rules": [
        {"name": "none", "match": {"subject_contains": ["digest"]}},
        {"name": "digest", "match": {"from_domain": ["news.example"]},
         "assign": {"category_path": "News & Digests", "export_profile": "scrubbed"}},
        {"name": "bill", "match": {"subject_contains": ["Bill"]}, "assign_hint": {"category_path": "Money/Bills", "sensitivity": "high"}},
    ]},
    "taxonomy": {"locked_categories": [{"path": "Money/Bills"}, {"path": "personal"}]},
}
LIMITS = PackLimits("t", 50, 10, 30, 100_000, 50_000, UNLIMITED, UNLIMITED, 2)


def mail(sender, subject, body, number, reply=None, date="Mon, 01 Jan 2024 10:00:00 +0100", labels=None, attach=(), **headers):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"] = sender, 'Ann <Ann@x.example>, "Bo, Jr" <bo@x.example>', subject, date
    m["Message-ID"] = f"<{number}@x>"
    if reply:
        m["References"] = f"<{reply}@x> <other@x>"
    if labels:
        m["X-Gmail-Labels"] = labels
    for k, v in headers.items():
        m[k] = v
    m.set_content(body)
    for name, data in attach:
        m.add_attachment(data, maintype="application", subtype="pdf", filename=name)
    return m


def mails():
    return [
        mail("News <Daily@News.example>", "Weekly digest", "Call 555-867-5309 or write a@b.example.\n", 1, labels="Inbox, Big News"),
        mail("ann@x.example", "Re: Weekly digest", "Thanks\n", 2, 1, "Tue, 02 Jan 2024 10:00:00 +0000"),
        mail("bank@y.example", "Your Bill", "SSN 123-45-6789, card 1234 5678 9012 3456\n", 3, date="broken", labels="Inbox"),
        mail("Zoë <zoe@z.example>", "=?utf-8?q?Gr=C3=BC=C3=9Fe?=", "Hello\nFrom here on.\n", 4, date="Wed, 03 Jan 2024 10:00:00 -0000",
             attach=[("a b.pdf", b"one"), ("a b.pdf", b"two"), ("e.pdf", b"")]),
    ]


def write(path, messages):
    box = mailbox.mbox(str(path))
    box.lock()
    for m in messages:
        box.add(mailbox.mboxMessage(m))
    box.flush()
    box.close()
    return str(path)


@pytest.fixture
def archive(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "state"), CONFIG)
    a.initialize()
    a.add_account("me", "Me", "me@x.example")
    return a


def test_mbox_reader_matches_the_mailbox_module(spark, tmp_path):
    path = write(tmp_path / "box.mbox", [*mails(), mail("a@b.example", "", "", 9)])
    Path(path).write_bytes(Path(path).read_bytes() + b"From x\nSubject: s\n\nno blank line\nFrom y\nSubject: t\n\nend\n\n")
    plain = mailbox.mbox(path)
    want = {k: plain.get_bytes(k) for k in plain.keys()}
    got = {r.mbox_key: bytes(r.raw) for r in read_mbox(spark, path).collect()}
    assert got == want
    assert sorted(r.mbox_key for r in read_mbox(spark, path, after=4).collect()) == [5, 6]
    (tmp_path / "lead.mbox").write_bytes(b"junk\n\nFrom a\nSubject: x\n\nb\n")
    assert [(r.mbox_key, bytes(r.raw)) for r in read_mbox(spark, str(tmp_path / "lead.mbox")).collect()] == [(0, b"Subject: x\n\nb\n")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert {r.mbox_key: bytes(r.raw) for r in read_mbox(spark, path).collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ingest(archive, tmp_path):
    path = write(tmp_path / "box.mbox", mails())
    assert archive.ingest(path, "me", extract=True) == {"seen": 4, "inserted": 4, "replaced": 0, "errors": 0, "skipped": 0}
    assert archive.ingest(path, "me") == {"seen": 4, "inserted": 0, "replaced": 0, "errors": 0, "skipped": 4}
    rows = {r.message_id: r for r in archive.table("messages").collect()}
    one, two, three, four = (rows[f"<{i}@x>"] for i in range(1, 5))
    assert one.sender == "daily@news.example" and one.recipients == ["ann@x.example", "bo@x.example"]
    assert (one.thread_key, two.thread_key) == ("<1@x>", "<1@x>")
    assert (one.date_utc, three.date_utc, four.date_utc) == ("2024-01-01T10:00:00+01:00", None, "2024-01-03T10:00:00")
    assert four.subject == "Grüße" and four.attachment_count == 3 and ">From here" in four.body_text
    assert one.labels == ["Inbox", "Big News"]
    assert {(r.label_name, r.normalized_name) for r in archive.table("labels").collect()} == {("Inbox", "inbox"), ("Big News", "big-news")}
    threads = {r.thread_key: r for r in archive.table("threads").collect()}
    assert threads["<1@x>"].message_count == 2 and threads["<1@x>"].date_max == "2024-01-02T10:00:00+00:00"
    kept = sorted((r.safe_filename, r.extraction_status, r.storage_path and Path(r.storage_path).read_bytes())
                  for r in archive.table("attachments").collect())
    assert kept == [("a_b.pdf", "extracted", b"one"), ("a_b.pdf", "extracted", b"two"), ("e.pdf", "empty", None)]
    with pytest.raises(AccountError):
        archive.ingest(path, "nobody")
    assert archive.ingest(path, "nobody", create=True)["inserted"] == 4
    run = archive.table("ingest_runs").filter("id = 1").first()
    assert (run.status, run.last_mbox_key, run.messages_inserted) == ("completed", 3, 4)


def test_force_replaces_message_and_dependents(archive, tmp_path):
    path = write(tmp_path / "box.mbox", mails())
    archive.ingest(path, "me")
    archive.classify("message")
    archive.classify("thread")
    archive.scan()
    before = {r.mbox_key: r.body_hash for r in archive.table("messages").collect()}
    changed = mails()
    changed[1].set_content("Other\n")
    Path(path).unlink()
    write(path, changed)
    assert archive.ingest(path, "me", force=True) == {"seen": 4, "inserted": 4, "replaced": 4, "errors": 0, "skipped": 0}
    after = {r.mbox_key: r.body_hash for r in archive.table("messages").collect()}
    assert {k for k in before if before[k] != after[k]} == {1}
    ids = {r.id for r in archive.table("messages").collect()}
    assert len(ids) == 4
    for name in ("message_labels", "security_findings", "attachments"):
        assert {r.message_db_id for r in archive.table(name).collect()} <= ids
    left = archive.table("classifications").collect()
    assert left and all(r.target_type == "thread" for r in left)


def test_resume(archive, tmp_path):
    path = write(tmp_path / "box.mbox", mails())
    archive.ingest(path, "me")
    run = archive.table("ingest_runs").first().asDict()
    archive._run(run | {"status": "interrupted", "last_mbox_key": 1})
    archive.store.write("messages", archive.table("messages").filter("mbox_key <= 1"))
    assert archive.ingest(path, "me", resume=True) == {"seen": 2, "inserted": 2, "replaced": 0, "errors": 0, "skipped": 2}
    archive._run(run | {"status": "running", "last_mbox_key": 999})
    assert archive.ingest(path, "me", resume=True)["skipped"] == 4


@pytest.mark.parametrize("error", [KeyboardInterrupt, OSError])
def test_interrupt_and_resume(archive, tmp_path, monkeypatch, error):
    """Batches are committed with their checkpoint; what was not committed is not there, and a resumed run adds it."""
    from postmill.operators import state

    archive.config = CONFIG | {"ingest": {"batch_commit_size": 2}}
    path = write(tmp_path / "box.mbox", [*mails(), mail("z@z", "five", "5\n", 5)])
    shape, calls = archive._shaped, []

    def broken(name, rows):
        calls.append(name)
        if name == "message_labels" and calls.count(name) == 2:  # within the second commit, when its messages are written already
            raise error("stop")
        return shape(name, rows)

    monkeypatch.setattr(archive, "_shaped", broken)
    if error is KeyboardInterrupt:
        assert archive.ingest(path, "me") == {"seen": 2, "inserted": 2, "replaced": 0, "errors": 0, "skipped": 0}
    else:
        with pytest.raises(OSError, match="stop"):
            archive.ingest(path, "me")
    monkeypatch.undo()
    run = archive.table("ingest_runs").first()
    assert (run.status, run.last_mbox_key, run.messages_inserted) == ("interrupted", 1, 2)
    assert {r.mbox_key for r in archive.table("messages").collect()} == {0, 1}
    assert {r.thread_key for r in archive.table("threads").collect()} == {"<1@x>"}
    assert [r.last_mbox_key for r in state.resume_points(archive.table("ingest_runs")).collect()] == [1]
    assert archive.ingest(path, "me", resume=True) == {"seen": 3, "inserted": 3, "replaced": 0, "errors": 0, "skipped": 2}
    rows = archive.table("messages").collect()
    assert sorted(r.mbox_key for r in rows) == [0, 1, 2, 3, 4] and len({r.id for r in rows}) == 5
    assert [(r.id, r.status, r.last_mbox_key) for r in archive.table("ingest_runs").collect()] == [(1, "completed", 4)]
    assert sum(r.message_count for r in archive.table("threads").collect()) == 5
    assert archive.table("message_labels").count() == 3


def test_broken_mailbox(archive, tmp_path):
    with pytest.raises(FileNotFoundError):
        archive.ingest(str(tmp_path / "none.mbox"), "me")


def test_attachments_on_disk(archive, tmp_path, monkeypatch):
    """Taken names are numbered, unwritable ones become error rows, and parts that cannot be read an error of the message."""
    path = write(tmp_path / "box.mbox", mails())
    folder = tmp_path / "files"
    target = folder / "me" / "2024" / "4-x"
    target.mkdir(parents=True)
    (target / "a_b.pdf").write_bytes(b"older")
    archive.ingest(path, "me", extract=True, attachments_dir=str(folder))
    kept = sorted((Path(r.storage_path).name, Path(r.storage_path).read_bytes()) for r in archive.table("attachments").collect() if r.storage_path)
    assert kept == [("a_b-1.pdf", b"one"), ("a_b-2.pdf", b"two")] and (target / "a_b.pdf").read_bytes() == b"older"
    (tmp_path / "plain").write_bytes(b"")  # a file where a folder should be
    archive.add_account("you")
    archive.ingest(path, "you", extract=True, attachments_dir=str(tmp_path / "plain"))
    rows = archive.table("attachments").filter("account_key = 'you'").collect()
    assert sorted(r.extraction_status for r in rows) == ["empty", "error", "error"] and all(r.error_message for r in rows if r.size_bytes)
    archive.add_account("they")
    archive.ingest(path, "they", extract=True, to_disk=False)
    assert {r.extraction_status for r in archive.table("attachments").filter("account_key = 'they'").collect()} == {"pending", "empty"}


def test_attachment_errors(archive, tmp_path):
    """A part whose name cannot be decoded is an error row; its message is kept."""
    bad = mails()[3]
    raw = bytes(bad).replace(b'filename="a b.pdf"', b"filename*0*=bogus''%41", 1)
    raw = raw.replace(b"filename*0*=bogus''%41", b'filename="=?utf-8?b?A?="').replace(b"From here", b">From here")
    (tmp_path / "box.mbox").write_bytes(b"From a\n" + raw + b"\n")
    assert archive.ingest(str(tmp_path / "box.mbox"), "me", extract=True)["inserted"] == 1
    errors = archive.table("ingest_errors").collect()
    assert [(r.error_type, r.mbox_key) for r in errors] == [("AttachmentError", 0)] and errors[0].error_message


def test_two_accounts_in_one_export(archive, tmp_path):
    archive.add_account("you", "You", "you@x.example")
    path = write(tmp_path / "box.mbox", mails())
    archive.ingest(path, "me")
    archive.ingest(path, "you")
    both = archive.export_packs(LIMITS, str(tmp_path / "out"), ["me", "you"])
    assert [(s["account_key"], s["files_written"], s["messages_exported"]) for s in both] == [("me", 3, 4), ("you", 3, 4)]
    for s in both:
        rows = list(csv.DictReader(open(s["manifest_csv"])))
        assert {r["account_key"] for r in rows} == {s["account_key"]} and all(Path(r["source_path"]).is_file() for r in rows)
    assert sorted((r.account_key, r.status, r.source_count) for r in archive.table("exports").collect()) == [("me", "completed", 3), ("you", "completed", 3)]
    assert archive.table("export_items").groupBy("account_key", "export_id").count().count() == 2


def test_migrations(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "new"))
    assert a.migrate() == ["001_initial", "002_multi_account"] and a.migrate() == [] and a.initialize() == []
    old = Archive(spark, str(tmp_path / "old"))  # messages of a first version: no account, no version table
    old.store.write("messages", spark.createDataFrame([(1, "s")], "id long, subject string"))
    assert old.migrate() == ["002_multi_account"]
    assert [r.version for r in old.table("schema_migrations").orderBy("version").collect()] == ["001_initial", "002_multi_account"]
    assert old.table("messages").first().account_key is None and old.table("messages").first().subject == "s"


def test_classification(archive, tmp_path):
    archive.ingest(write(tmp_path / "box.mbox", mails()), "me")
    assert archive.classify("thread") == {"classified": 2, "skipped": 1}
    rows = archive.table("classifications").collect()
    assert sorted((r.target_type, r.category_path, r.classifier_type) for r in rows) == [
        ("message", "money/bills", "rule_inherited"), ("message", "news-and-digests", "rule_inherited"),
        ("message", "news-and-digests", "rule_inherited"), ("thread", "money/bills", "rule_hint"), ("thread", "news-and-digests", "rule")]
    evidence = json.loads(next(r.raw_output_json for r in rows if r.classifier_type == "rule"))
    assert evidence["participants"] == ["ann@x.example", "bo@x.example", "daily@news.example"] and evidence["message_count"] == 2
    assert archive.classify("thread") == {"classified": 0, "skipped": 1}
    assert archive.table("classifications").count() == 5
    assert archive.classify("message") == {"classified": 2, "skipped": 2}
    assert archive.seed_categories("me") == 2 and archive.seed_categories("me") == 0
    counts, _ = archive.review("me")
    assert {r["path"]: r["messages"] for r in counts} == {"money/bills": 2, "personal": 0}
    assert Archive(archive.spark, archive.root, {}).classify() == {"classified": 0, "skipped": 0}


def test_explicit_rows_block_inheritance(archive, tmp_path):
    archive.ingest(write(tmp_path / "box.mbox", mails()), "me")
    archive.classify("message")
    archive.classify("thread")
    got = sorted((r.message_db_id, r.classifier_type) for r in archive.table("classifications").collect() if r.message_db_id)
    assert got == [(1, "rule"), (2, "rule_inherited"), (3, "rule_hint")]


def test_packs_and_lines(archive, tmp_path):
    archive.ingest(write(tmp_path / "box.mbox", mails()), "me")
    archive.classify("thread")
    assert archive.scan("me") == {"scanned": 4, "findings": 4}
    dry = archive.export_packs(LIMITS, str(tmp_path / "out"), "me", dry_run=True)
    assert dry["would_write"] == 3 and not (tmp_path / "out").exists()
    stats = archive.export_packs(LIMITS, str(tmp_path / "out"), "me")
    assert (stats["files_written"], stats["messages_exported"]) == (3, 4)
    rows = list(csv.DictReader(open(stats["manifest_csv"])))
    assert sum(int(r["message_count"]) for r in rows) == 4 and [r["category_path"] for r in rows] == ["money/bills", "news-and-digests", "unclassified"]
    for r in rows:
        assert int(r["byte_count"]) == Path(r["source_path"]).stat().st_size
    news = Path(rows[1]["source_path"]).read_text()
    assert "([" not in news and "Call [PHONE REDACTED] or write [EMAIL REDACTED]." in news and "from: daily@news.example" in news
    assert "SSN [SSN REDACTED], card [CARD REDACTED]" in Path(rows[0]["source_path"]).read_text()
    assert rows[0]["contains_scrubbed_content"] == "True" and rows[2]["contains_scrubbed_content"] == "False"
    assert {r.output_file for r in archive.table("export_items").collect()} == {r["source_path"] for r in rows}
    assert archive.table("exports").first().status == "completed"
    one = archive.export_packs(PackLimits("t", 1, 0, 1, 9, 9, UNLIMITED, UNLIMITED, 1), str(tmp_path / "out1"), "me")
    assert one["files_written"] == 1
    bare = archive.export_packs(LIMITS, str(tmp_path / "out2"), "me", profile="metadata-only")
    assert "*(no body)*" in Path(json.load(open(bare["manifest_json"]))[0]["source_path"]).read_text()

    done = archive.export_lines(str(tmp_path / "me" / "lines.jsonl"), "me")
    lines = [json.loads(x) for x in open(done["path"])]
    assert [x["message_id"] for x in lines] == ["<1@x>", "<2@x>", "<4@x>", "<3@x>"]
    assert list(lines[0])[:6] == ["id", "message_id", "thread_key", "subject", "sender", "date_utc"]
    assert list(lines[0])[-1] == "classification" and "classification" not in lines[2]
    manifest = json.load(open(done["manifest"]))[0]
    assert manifest["message_count"] == 4 and manifest["byte_count"] == Path(done["path"]).stat().st_size


def test_accounts_and_proposals(archive):
    with pytest.raises(AccountError):
        archive.add_account("me")
    assert archive.resolve_account(None)["account_key"] == "me"
    assert archive.update_account("me", notes="n") and not archive.update_account("me") and not archive.update_account("x", notes="n")
    assert archive.default_account()["account_key"] == "default"
    with pytest.raises(AccountError):
        archive.resolve_account(None)
    rows = [(1, "me", "A/B", None, 0.5, "pending", "1", None, None), (2, "me", "C", None, None, "pending", "0", None, None),
            (3, "me", "D", None, 0.9, "pending", "2", None, None)]
    archive._append("category_proposals", archive._rows("category_proposals", rows))
    assert [p["id"] for p in archive.review("me")[1]] == [3, 1, 2]
    assert archive.decide(1, True, "good one") == "A/B"
    assert archive.decide(1, False, "late") is None and archive.decide(2, False) is None
    reviewed = {r.id: r for r in archive.table("category_proposals").collect()}
    assert (reviewed[1].status, reviewed[1].reviewed_note, reviewed[2].status, reviewed[2].reviewed_note) == ("approved", "good one", "rejected", "")
    assert reviewed[1].reviewed_at and reviewed[2].reviewed_at and reviewed[3].reviewed_at is None
    with pytest.raises(Exception, match="pending"):
        archive.decide(1, True)
    assert [r.path for r in archive.table("categories").collect()] == ["a/b"]


def test_command_line(spark, tmp_path, capsys):
    from postmill.cli import main

    db = ["--db", str(tmp_path / "s")]
    assert main(["init-db", *db]) == 0 and main(["account", "add", *db, "me"]) == 0
    path = write(tmp_path / "box.mbox", mails())
    assert main(["ingest", *db, path]) == 0
    assert main(["export", "jsonl", *db, "--out", str(tmp_path / "x.jsonl")]) == 0
    assert (tmp_path / "me" / "x.jsonl").exists()
    assert main(["account", "show", *db, "none"]) == 1
    assert main(["security-scan", *db]) == 0 and main(["review-categories", *db]) == 0
    assert "no account" in capsys.readouterr().err


def test_streaming_ingest(spark, tmp_path):
    from postmill.streaming.ingest import ingest_folder

    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.mbox", mails()[:2])
    run = lambda: ingest_folder(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    write(folder / "b.mbox", mails()[2:])
    run()
    run()
    assert sorted(r.message_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["<1@x>", "<2@x>", "<3@x>", "<4@x>"]


def test_streaming_windows(spark, tmp_path):
    from postmill.streaming.ingest import first_seen
    from postmill.streaming.windows import tumbling_counts

    rows = spark.createDataFrame([(i, i // 2, "ab"[i % 2]) for i in range(600)], "event_id long, n long, event_type string").withColumn(
        "ts", F.timestamp_seconds(F.col("event_id") * 60))
    rows.repartitionByRange(4, "event_id").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    q = tumbling_counts(stream, "1 hour", "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("w").collect()} == {tuple(r) for r in tumbling_counts(rows, "1 hour").collect()}
    q = first_seen(stream, ["n"], "1 day").writeStream.format("memory").queryName("d").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("d").count() == 300


