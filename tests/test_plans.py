"""Plans stay the plans we want: no products, no Python in relational queries, filters and columns at the scan."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CODECS = {"ooxml_word_round_trip", "ooxml_word_to_slides", "ooxml_sheet_round_trip", "pdf_round_trip", "zip_bundle_listing", "image_headers", "vba_macro_listing", "log_stream", "task_state_stream", "ingest_stream", "zip_parts"}
CODECS |= {"word_object_counts", "valid_packages", "pdf_as_word", "sheets_as_pdf", "sheets_as_word", "sheets_as_slides", "native_charts", "merged_tables", "big_table_pages", "word_previews", "file_previews", "notes_placeholders", "picture_properties", "resolved_styles", "theme_styles", "shared_strings", "slide_tables", "word_pictures", "picture_places"}
NAMES = sorted(k for k in entry.queries() if not re.match(r"op\d|pipeline", k) and k not in CODECS)


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_native_without_products(spark, name):
    text = plan(spark, name)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    assert not re.search("Python|Pandas|InArrow|ArrowEval|ArrowAggregate|ArrowWindow|ArrowUDTF", text)  # nodes; names of HTML entities end in Arrow too


@pytest.mark.parametrize(("name", "filters", "columns"), [("reports_of_task", "EqualTo(o_custkey,7)", "o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderdate"), ("log_tail", "EqualTo(event_type,error)", "event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string"), ("conjunctive_filter", "In(source, [src1,src2])", "doc_id:bigint,text:string,source:string,n_chars:bigint"), ("type_status_dashboard", "", "lang:string,source:string,n_chars:bigint")])
def test_pushdown(spark, name, filters, columns):
    text = entry.queries()[name](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert filters in text and f"ReadSchema: struct<{columns}" in text


def test_documents_are_whole(spark, sf):
    """Every document with a line goes through the round trips."""
    from docengine.plans.sheets import lines

    every = {str(r.doc_id) for r in lines(spark, sf).select("doc_id").distinct().collect()}
    for name in ("ooxml_word_round_trip", "ooxml_word_to_slides", "pdf_round_trip"):
        got = entry.queries()[name](spark, sf)
        assert {r.doc_id.rsplit(".", 1)[0] for r in got.select("doc_id").distinct().collect()} == every, name
        assert not got.filter("error is not null").count(), name


def test_media_locations_hold_no_set_of_all_relations(spark):
    """Repeats are told apart by the columns that matter, not by whole relations once more in every branch."""
    sets = [line for line in plan(spark, "media_locations").splitlines() if "HashAggregate(" in line]
    assert sets and not [line for line in sets if "external" in line]


def test_listings_of_decks_are_written(spark):
    """The decks are made for their listing and once for their relations, not again for every check of the listing."""
    assert plan(spark, "valid_packages").count("MapInArrow") == 2  # made, then read for the relations
