from pyspark.sql import functions as F

from lociframe.operators.records import DAY, Rule, RuleSet, apply_rules, bulk_replace, expires_at, list_files, manifest_diff, mark_listed

RULES = RuleSet(
    tagging=[
        Rule(listed=["listed"], flags=["Protected"]),
        Rule(subject=["invoice"], flags=["sensitive"]),
        Rule(subject=["receipt"], folders=["Receipts", "archive"], flags=["\\Seen"]),
        Rule(header_exists=["list-unsubscribe"], folders=["Mail List"], expire=60 * DAY),
        Rule(sender=["boss"], flags=["Protected", "Retain"]),
    ],
    disposal=[Rule(subject=["deleteme"], folders=["trash"], expire=7 * DAY), Rule(subject=["unsub"], flags=["reject", "report", "junk"])],
    discard=Rule(subject=["drop"]),
    spammers=Rule(sender=["spammer"]),
    loop=Rule(header_is=[("received", "spam.example.net")]),
)

MESSAGES = {
    # name: (sender, subject, headers, score, prior flags) -> action, folders, flags, expiry
    "plain": (("a", "hello", {}, 0, []), ("keep", set(), set(), None)),
    "receipt": (("a", "Your RECEIPT", {}, 0, []), ("file", {"Receipts", "archive"}, {"\\Seen"}, None)),
    "list": (("a", "hi", {"list-unsubscribe": "x"}, 0, []), ("file", {"Mail List"}, set(), 60 * DAY)),
    "retain": (("The Boss", "deleteme", {"list-unsubscribe": "x"}, 9, []), ("keep", {"Mail List", "inbox"}, {"Protected", "Retain"}, None)),
    "friend": (("friend", "unsub drop", {}, 9, []), ("keep", set(), {"Protected"}, None)),
    "trash": (("a", "deleteme", {}, 0, []), ("file", {"trash"}, set(), 7 * DAY)),
    "spam": (("a", "x", {}, 8, []), ("file", {"spam"}, {"\\Seen", "junk", "report", "reported"}, 3600)),
    "junk": (("a", "x", {}, 3, []), ("file", {"spam"}, {"\\Seen", "junk"}, None)),
    "spammer": (("spammer", "deleteme", {}, 0, []), ("file", {"trash", "spam"}, {"\\Seen", "junk", "report", "reported"}, 3600)),
    "reject": (("a", "unsub", {}, 0, []), ("reject", {"spam"}, {"reject", "report", "junk", "reported"}, None)),
    "loop": (("a", "unsub", {"received": "spam.example.net"}, 0, []), ("discard", {"spam"}, {"reject", "report", "junk"}, None)),
    "sensitive": (("a", "invoice", {}, 9, []), ("keep", {"spam"}, {"sensitive", "\\Seen", "junk", "report"}, None)),
    "again": (("a", "x", {}, 9, ["reported"]), ("file", {"spam"}, {"reported", "\\Seen", "junk", "report"}, 3600)),
    "drop": (("a", "drop", {}, 0, []), ("discard", set(), set(), None)),
}


def test_rules(spark):
    rows = [(k, *m[0][:2], "me", m[0][2], m[0][3], m[0][4]) for k, m in MESSAGES.items()]
    df = spark.createDataFrame(rows, "k string, sender string, subject string, recipients string, headers map<string,string>, spam_score int, prior_flags array<string>")
    df = mark_listed(df, spark.createDataFrame([("friend",), ("friend",)], "sender string"))
    got = {r.k: r for r in apply_rules(df, RULES).collect()}
    assert len(got) == len(MESSAGES)
    for k, (_, (action, folders, flags, expiry)) in MESSAGES.items():
        r = got[k]
        assert (r.action, set(r.folders), set(r.flags), r.expires_in) == (action, folders, flags, expiry), k


def test_expiry(spark):
    df = spark.createDataFrame([(3600,), (None,)], "expires_in long").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert [str(r.expires_at) for r in expires_at(df).collect()] == ["2024-01-01 01:00:00", "None"]


def test_manifest_diff_folders_first_and_same(spark, tmp_path):
    a = spark.createDataFrame([("b", 1, "x"), ("a/", 0, "y"), ("c", 2, "z")], "path string, size long, md5 string")
    b = a.where("path = 'c'")
    assert [r.path for r in manifest_diff(a, b).collect()] == ["a/", "b"]
    assert manifest_diff(a, a).isEmpty()
    (tmp_path / "f").write_text("hi")
    r = list_files(spark, str(tmp_path)).first()
    assert (r["size"], r.md5) == (2, "49f68a5c8493ec2c0bf489821c21fc3b")


def test_bulk_replace(spark):
    df = spark.createDataFrame([("a.a",), ("b",)], "text string")
    assert [r.text for r in bulk_replace(df, r"a\.", "x").collect()] == ["xa", "b"]
    assert [r.text for r in bulk_replace(df, "a", "x", dry_run=True).collect()] == ["a.a"]
