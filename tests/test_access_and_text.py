"""Guards, sources, memo audit and streaming."""

import zipfile

import pytest
from pyspark.sql import functions as F

from loanloom import config, settings as S
from loanloom.operators import memo, scoring
from loanloom.plans import memos
from loanloom.sources import logs, readers, sinks


def test_locked_splits(spark):
    df = spark.createDataFrame([("a", "train"), ("b", "test_in_time")], "loan_seq string, split string")
    assert readers.load_split_guarded(df, "train").count() == 1
    with pytest.raises(PermissionError):
        readers.load_split_guarded(df, ["train", "test_in_time"])
    with pytest.raises(ValueError):
        readers.load_split_guarded(df, "nonsense")
    with pytest.raises(PermissionError):
        readers.load_fresh_guarded(df)
    assert readers.load_split_guarded(df, "test_in_time", allow_test=True).count() == 1


def test_zip_members_are_streamed_and_missing_ones_refused(spark, tmp_path):
    for name, members in (("one", {"one_orig.txt": "a|1\nb|\n", "stray.txt": "x"}), ("two", {"two_orig.txt": "c|3\n"})):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for m, text in members.items():
                z.writestr(m, text)
    lines = readers.scan_zip_members(spark, str(tmp_path / "*.zip"), {"orig": "{stem}_orig.txt"})
    rows = readers.lines_to_columns(lines.select("line"), ["k", "v"]).collect()
    assert {tuple(r) for r in rows} == {("a", "1"), ("b", None), ("c", "3")}
    with pytest.raises(Exception, match="does not contain"):
        readers.scan_zip_members(spark, str(tmp_path / "*.zip"), {"x": "stray.txt"}).count()


def test_every_zip_member_is_a_task(spark, tmp_path):
    for name in ("one", "two", "three"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for kind in ("orig", "perf"):
                z.writestr(f"{name}_{kind}.txt", "a|1\nb|2\n")
    lines = readers.scan_zip_members(spark, str(tmp_path / "*.zip"), {"orig": "{stem}_orig.txt", "perf": "{stem}_perf.txt"})
    tasks = lines.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 12 and len(tasks) >= 5  # small tasks are not merged into one


def test_malformed_lines_stop_the_job(spark):
    df = spark.createDataFrame([("a|b|c",)], "line string")
    with pytest.raises(Exception, match="wrong number of fields"):
        readers.lines_to_columns(df, ["k", "v"]).collect()


def test_manifest_diff(spark):
    schema = "name string, size bigint, sha256 string"
    mine = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], schema)
    theirs = spark.createDataFrame([("a", 1, "x"), ("b", 9, "q"), ("d", 1, "w")], schema)
    got = {r["name"]: (r["action"], r["problem"]) for r in sinks.file_manifest_diff(mine, theirs).collect()}
    assert got == {"a": ("skip", None), "b": ("upload", "size differs"), "c": ("upload", "missing"), "d": ("unexpected", None)}


def test_report_lines(spark):
    text = ["REPORT RequestId: 1\tDuration: 2.50 ms\tBilled Duration: 3 ms\tMemory Size: 512 MB\tMax Memory Used: 80 MB\tInit Duration: 900.5 ms",
            "REPORT RequestId: 2\tDuration: 4.00 ms\tBilled Duration: 4 ms\tMemory Size: 512 MB\tMax Memory Used: 81 MB", "START RequestId: 3", "REPORT nothing"]
    rows = logs.parse_report_lines(spark.createDataFrame([(t,) for t in text], "value string")).orderBy("duration_ms").collect()
    assert [(r["duration_ms"], r["billed_ms"], r["init_ms"], r["cold_start"]) for r in rows] == [(2.5, 3.0, 900.5, True), (4.0, 4.0, None, False)]


def test_request_rules(spark):
    good = dict(credit_score=700, dti=44.0, ltv=85.0, cltv=85.0, interest_rate=4.55, reference_rate=4.0, number_of_borrowers=1, mi_pct=25.0, term_months=360, purpose="P")
    schema = ("credit_score int, dti double, ltv double, cltv double, interest_rate double, reference_rate double, number_of_borrowers int, mi_pct double, "
              "term_months int, purpose string")
    rows = [good, {**good, "credit_score": 900, "purpose": "Q"}, {**good, "dti": None}]
    got = [r["violations"] for r in scoring.validate_application(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect()]
    assert got == [[], ["credit_score", "purpose"], []]


@pytest.mark.parametrize("language", ["en", "fr"])
def test_template_memo_passes_its_own_audit(spark, sf, language):
    from loanloom.session import write_scratch
    texts = write_scratch(memo.memo_render(memos.facts(spark, sf, language), language), "memo-test")
    bad = memo.memo_text_audit(texts, "memo", language).filter(F.size("problems") > 0).select("memo", "problems").take(1)
    assert bad == []


def test_number_audit(spark):
    allowed = F.array(*[F.lit(v).cast(memo.FACT_TYPE) for v in ("9.17", "52.1", "-0.55", "24")])
    df = spark.createDataFrame([("Risk 9,17 % and 9.2 and 9 over 24 months, rate -0.55 or −0,6, 36-24, loses -52.1, 1.000000", )], "t string")
    r = df.select(memo.memo_number_audit(F.col("t"), allowed).alias("bad")).withColumn("hint", memo.sign_hints(F.col("bad"), allowed)).first()
    assert r["bad"] == ["-52.1", "1.000000", "36"] and r["hint"] == ["52.1"]


def test_policy_lines(spark):
    df = spark.createDataFrame([(0.0199,), (0.02,), (0.05,), (0.0501,)], "p double")
    assert [r[0] for r in df.select(scoring.policy_decision(F.col("p"))).collect()] == ["approve", "refer", "refer", "decline"]
    with pytest.raises(Exception, match="between 0 and 1"):
        spark.createDataFrame([(1.5,)], "p double").select(scoring.policy_decision(F.col("p"))).collect()


def test_config_rules():
    cfg = config.load_config()
    assert cfg["policy"]["approve_below"] == S.POLICY["approve_below"] and cfg["scaling"] == S.SCALING
    with pytest.raises(config.ConfigError):
        config.validate({**cfg, "policy": {**cfg["policy"], "approve_below": 0.9}})


def test_searches_equal_their_plain_definitions(spark):
    """Words found by their letters first, counts and blanks without taking texts apart: same answers, fewer steps."""
    parts = ("", "x", "é", " ", "\n", "_", "-", "3", "%", " ", "ten ", "attend", "(ten)", "TEN", "per cent", "approve", "approved", "approvals", "refer", "referral", "refers to", "reference", "4.50", "−3,5")
    df = spark.createDataFrame([(a + b + c,) for a in parts for b in parts for c in parts[:8]], "t string")
    t, low, words, stems = F.col("t"), F.lower("t"), ["ten", "per cent"], [r"approv\w*", "refer(?:s|red|ral|ring)?", "a|b"]
    allowed = F.array(*[F.lit(v).cast(memo.FACT_TYPE) for v in ("4.5", "-3.46", "3", None)])
    every = F.filter(memo.parsed_tokens(memo.number_tokens(t)), lambda x: ~memo.is_fact(x, allowed))
    plain = {
        "squash": (memo.squash(t), F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), " %", "%"))),
        "blank": (memo.blank(t), F.regexp_replace(t, r"(?U)\s", "") == ""),
        "count": (memo.count_words(t), F.size(F.regexp_extract_all(t, F.lit(f"({memo.WORD}+)"), 1))),
        "between": (memo.words_between(t, 2, 3), F.size(F.regexp_extract_all(t, F.lit(f"({memo.WORD}+)"), 1)).between(2, 3)),
        "any": (memo.has_any_word(low, words), memo.has_word(low, "|".join(words))),
        "stem": (memo.has_stem(low, "decline", stems), memo.has_word(low, "|".join(["decline", *stems]).replace(r"\w", memo.WORD))),
        "numbers": (memo.memo_number_audit(t, allowed), F.array_sort(F.transform(every, lambda x: x["token"]))),
    }
    differing = df.agg(*[F.count_if(~a.eqNullSafe(b)).alias(k) for k, (a, b) in plain.items()]).first().asDict()
    assert differing == dict.fromkeys(plain, 0)
