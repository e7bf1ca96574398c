"""The end-to-end jobs give the same rows as the per-operator queries."""

from pyspark.sql import functions as F

from oracle_harness import SMALL
from pagemill.plans import block_queries as BQ
from pagemill.plans import image_queries as IQ
from pagemill.plans import jobs as J
from pagemill.sources.fixtures import gallery_assets, gallery_pages, generations


def rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_scrape_with_rendered_fallback(spark, tmp_path):
    out = J.scrape(gallery_pages(spark, SMALL), str(tmp_path), gallery_pages(spark, SMALL, rendered=True))
    got = out["records"].select("page_id", F.posexplode("images").alias("p", "url")).select(
        "page_id", (F.col("p") + 1).alias("pos"), "url")
    want = IQ.q_rendered_merge(spark, SMALL)
    assert rows(got, ["page_id", "pos", "url"]) == rows(want, ["page_id", "pos", "url"])
    assert out["prompts"].count() == out["records"].count()
    assert out["prompts"].first()["system"].startswith("あなたは")


def test_assemble_matches_block_queries(spark, tmp_path):
    recs = J.scrape(gallery_pages(spark, SMALL), str(tmp_path / "a"))["records"]
    out = J.assemble(recs, generations(spark, SMALL), str(tmp_path / "b"), gallery_assets(spark, SMALL))
    cols = ["page_id", "kind", "style", "text", "image_url", "start_index", "end_index"]
    assert rows(out["blocks"], cols) == rows(BQ._blocks(spark, SMALL), cols)
    assert out["edits"].count() == 2 * out["blocks"].count()
    assert out["responses"].filter(~F.col("success")).count() == 0
    assert "content_type" in out["blocks"].columns


def test_cli_scrape_writes_tables(tmp_path):
    import subprocess
    import sys
    out = tmp_path / "run"
    r = subprocess.run([sys.executable, "-m", "pagemill.plans.jobs", "scrape", "--pages",
                        f"{SMALL}/pages.parquet", "--out", str(out)], capture_output=True, text=True, timeout=600,
                       cwd=str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    assert r.returncode == 0, r.stderr[-2000:]
    assert (out / "records" / "_SUCCESS").exists() and (out / "prompts" / "_SUCCESS").exists()
