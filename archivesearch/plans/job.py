"""``spark-submit`` entry of the indexing chain (Q6).

    job.py pages ARCHIVES OUT [--collection NAME]     archives -> page table, counters in OUT_counters
    job.py links PAGES OUT [--slice POLICY]           page table -> inverted links
    job.py docs PAGES LINKS OUT [--slice POLICY] [--keep latest|all]   -> page documents as JSON lines
    job.py index PAGES OUT                            page table -> documents, versions, search index
"""

from __future__ import annotations

import argparse

from pyspark.sql import Observation
from pyspark.sql import functions as F

from archivesearch.functions import urls as U
from archivesearch.operators import extract as X
from archivesearch.operators import links as L
from archivesearch.operators.docs import document_versions, version_docs
from archivesearch.operators.fields import write_field_keys
from archivesearch.operators.index import build_index
from archivesearch.plans.indexing import observed_documents, page_documents_of, write_counters
from archivesearch.session import get_spark
from archivesearch.sources.archive import read_archive
from archivesearch.sources.sinks import write_json, write_parquet


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = p.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("pages")
    one.add_argument("archives")
    one.add_argument("out")
    one.add_argument("--collection", default="")
    one = jobs.add_parser("links")
    one.add_argument("pages")
    one.add_argument("out")
    one.add_argument("--slice", default="none")
    one = jobs.add_parser("docs")
    one.add_argument("pages")
    one.add_argument("links")
    one.add_argument("out")
    one.add_argument("--slice", default="none")
    one.add_argument("--keep", default="latest", choices=["latest", "all"])
    one = jobs.add_parser("index")
    one.add_argument("pages")
    one.add_argument("out")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = get_spark(app=f"archivesearch-{a.job}")
    if a.job == "pages":
        seen, cfg = Observation(), X.ExtractConfig()
        write_parquet(X.build_page_data(read_archive(spark, a.archives, accepted=cfg), cfg, a.collection, seen), a.out)
        write_counters(spark, seen, f"{a.out}_counters")
        return
    pages = spark.read.parquet(a.pages)
    if a.job == "links":
        write_parquet(L.invert_links(L.outlink_edges(pages), a.slice), a.out)
    elif a.job == "docs":
        seen = Observation()
        write_json(observed_documents(page_documents_of(pages, spark.read.parquet(a.links), a.slice, a.keep), seen), a.out)
        write_counters(spark, seen, f"{a.out}_counters")
    else:
        captures = pages.select("digest", "url", F.col("surt_url").alias("surt"), "tstamp", "collection", "title",
                                "content", "type", "warc_name")
        write_field_keys(captures, f"{a.out}/keys")
        write_parquet(document_versions(captures), f"{a.out}/versions")
        write_parquet(version_docs(captures).withColumn("site", U.url_host("urlOldest")), f"{a.out}/docs")
        build_index(spark.read.parquet(f"{a.out}/docs"), f"{a.out}/index")


if __name__ == "__main__":
    main()
