"""Readers, writers, the whole plan, and streams."""

import time

import pytest

from candorlake.plans import reviews as plan
from candorlake.sources import files


def test_raw_dialect(spark, tmp_path):
    (tmp_path / "merged_reviews_1.csv").write_text("x")
    a, b = tmp_path / "reviews_complete_a.csv", tmp_path / "reviews_complete_b.csv"
    a.write_text('﻿"Bewertungs-ID";"Bewertungstext"\n"1";"says ""hi""; and\nmore"\n', encoding="utf-8")
    b.write_text('"Bewertungs-ID";"Sterne"\n"1";"5"\n', encoding="utf-8")
    assert [p.rsplit("/", 1)[-1] for p in files.raw_paths(spark, str(tmp_path))] == [a.name, b.name]
    rows = sorted(files.read_raw(spark, files.raw_paths(spark, str(tmp_path))).collect(), key=lambda r: r.file_order)
    assert rows[0]["Bewertungs-ID"] == "1" and rows[0].Bewertungstext == 'says "hi"; and\nmore' and rows[1].Sterne == "5"
    time.sleep(1.1)
    a.touch()
    assert files.newest(spark, str(tmp_path)).endswith(a.name)


def test_no_raw_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.raw_paths(spark, str(tmp_path))


def test_optional_scores_and_reports(spark, tmp_path):
    assert files.read_scores(spark, f"{tmp_path}/none", ["x"]).count() == 0
    files.write_table(spark.createDataFrame([("a", 0.5)], "review_id string, x double"), f"{tmp_path}/s")
    assert files.read_scores(spark, f"{tmp_path}/s", ["x"]).first().x == 0.5
    files.write_json_report(spark, {"success": True, "ö": 1}, f"{tmp_path}/r")
    assert files.read_json_report(spark, f"{tmp_path}/r") == {"success": True, "ö": 1}


def test_upload_skips_known_files(spark, tmp_path):
    out, store = tmp_path / "out", tmp_path / "store"
    (out / "sub").mkdir(parents=True)
    (out / "a.csv").write_text("1"), (out / "sub" / "b.csv").write_text("2"), (out / "x_debug.csv").write_text("3")
    assert files.upload(spark, str(out), str(store)) == {"uploaded": 2, "skipped": 0}
    assert (store / "sub" / "b.csv").read_text() == "2" and not (store / "x_debug.csv").exists()
    (out / "a.csv").write_text("other")
    assert files.upload(spark, str(out), str(store)) == {"uploaded": 1, "skipped": 1}


def test_whole_plan(spark, tmp_path):
    titles = ["Bewertungs-ID", "Google Maps URL", "Restaurant", "Sterne", "Reviewer-ID", "Erstellt am", "Scrapingzeit", "Restaurant-Bewertung", "Bewertungstext", "Sprache"]
    lines = [";".join(f'"{t}"' for t in titles)]
    for i in range(1200):
        lines.append(";".join(f'"{v}"' for v in (i, f"http://m/data=!1sP{i % 9}!2s", f"P{i % 9}", 1 + i % 5, f"u{i % 97}", f"2024-{1 + i % 12:02d}-{1 + i % 28:02d} 10:00:00", "2025-01-01 00:00:00", 4.1, "ganz gut und nicht teuer", "de")))
    (tmp_path / "reviews_complete.csv").write_text("\n".join(lines))
    got = plan.run(spark, str(tmp_path), f"{tmp_path}/out", salt="s")
    assert got.report.success and got.scored.count() == 1200 and got.summary.count() == 9
    low, high = got.scored.selectExpr("min(suspicion_score)", "max(suspicion_score)").first()
    assert 0 <= low <= high <= 1
    assert spark.read.parquet(f"{tmp_path}/out/reviews_scored").filter("reviewer_user_id NOT LIKE 'uid!_%' ESCAPE '!'").isEmpty()
    vertices, edges = files.read_graph(spark, f"{tmp_path}/out/graph")
    assert vertices.count() == 106 and edges.count() == 1200


def test_stream_bursts(spark, tmp_path):
    from candorlake.streaming.daily import burst_batches, event_stream

    seen = []
    q = burst_batches(event_stream(spark, "/root/testdata/sf0.001"), lambda df, n: seen.append(df.agg({"review_count": "sum"}).first()[0]), str(tmp_path / "c"), "event_type")
    q.processAllAvailable(), q.stop()
    assert seen[-1] == 1000
