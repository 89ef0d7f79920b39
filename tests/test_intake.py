from decimal import Decimal as D

import pytest
from helpers import rows_of

from tuneledger.operators import dimensions
from tuneledger.plans import jobs
from tuneledger.schemas import REVENUE_SHEET
from tuneledger.sources import sheets

HEADER = ",".join(REVENUE_SHEET)


def line(id_="u1", total="1", royalty="0.1608771378", user="48", month="2023-04-01", product="Cloud 9", tail=""):
    return f"Apple,{month},INK782201237,{product},Cloud 9,Amrit,,Abhi,Apple,CA,{total},{royalty},{user},{id_}{tail}"


def intake(tiny, *lines):
    return sheets.intake_revenue(tiny.spark, tiny.text([HEADER, *lines]))


def test_good_and_bad_rows(tiny):
    short = line("gone").rsplit(",", 1)[0]
    kept, rejected = intake(
        tiny, line("a"), line("b", total="abc"), line("c", royalty="nan"), line("d", user="4.5"), line("e", user=""),
        line("f", total=" 1e2 ", user=" 48 "), line("g", tail=",more,fields"), line("h", product='"one, two"'),
        line("i", product='"say ""hi"""'), line("j", total="1d"), short)
    assert [r[0] for r in rows_of(kept, "id")] == ["a", "f", "g", "h", "i"]
    rows = {r.id: r for r in kept.collect()}
    assert (rows["a"].royalty, rows["a"].album, rows["a"].userid) == (D("0.160877"), "", 48)
    assert (rows["f"].total, rows["f"].userid) == (D("100.000000"), 48)
    assert (rows["h"].product, rows["i"].product) == ("one, two", 'say "hi"')
    assert sorted(r.fault for r in rejected.collect()) == ["bad number"] * 5 + ["missing field"]


def test_few_columns_do_not_hide_short_rows(tiny):
    kept, rejected = intake(tiny, line("a"), line("gone").rsplit(",", 1)[0])
    assert kept.select("service").count() == 1
    assert rejected.select("service").count() == 1


def test_header_is_skipped_in_every_file(tiny):
    path = tiny.text([HEADER, line("a")])
    other = tiny.text([HEADER, line("b")])
    lines = sheets.read_revenue_sheet(tiny.spark, [path, other])
    assert rows_of(lines, "id") == [("a",), ("b",)]


def test_line_breaks_inside_quotes(tiny):
    path = tiny.text([HEADER, line("a", product='"two\nlines"'), line("b")])
    kept, _ = sheets.intake_revenue(tiny.spark, path, multi_line=True)
    assert rows_of(kept, "id", "product") == [("a", "two\nlines"), ("b", "Cloud 9")]


def test_platform_sheet_by_header_name(tiny):
    path = tiny.text(["effective_from,platform_name,note,revenue_share_percentage",
                      "2023-01-01,Apple,x,70.00", "2023-01-01,Spotify,x,many", "2023-01-01,YouTube,x, 60 "])
    kept, rejected = sheets.intake_platforms(tiny.spark, path)
    assert rows_of(kept) == [("Apple", D(70), "2023-01-01"), ("YouTube", D(60), "2023-01-01")]
    assert rejected.count() == 1
    nameless = tiny.text(["name,share", "Apple,70"])
    assert sheets.intake_platforms(tiny.spark, nameless)[0].count() == 0


def test_raw_lines_split_at_every_comma(tiny):
    path = tiny.text([HEADER, line("a"), line("b", product='"one, two"')])
    assert rows_of(sheets.raw_line_fields(tiny.spark, path), "userid", "isrc", "label_name") == [
        ("0.1608771378", "INK782201237", ""), ("48", "INK782201237", "Abhi")]


def test_validate(tiny):
    path = tiny.text([HEADER, line("a"), line("b", total="abc")])
    row = sheets.validate_sheet(tiny.spark, path, "revenue").collect()[0]
    assert (row.rows_found, row.rows_rejected, row.valid) == (1, 1, True)
    assert '"id":"a"' in row.sample
    assert not sheets.validate_sheet(tiny.spark, tiny.text([HEADER]), "revenue").collect()[0].valid
    with pytest.raises(ValueError):
        sheets.validate_sheet(tiny.spark, path, "other")


@pytest.mark.parametrize("lines, rule", [
    ([line("a"), line("a")], "staging_id_unique"),
    ([line("a"), line("b", total="-1")], "staging_amounts_not_negative"),
    ([line("a"), line("b", month="soon")], "staging_required_present"),
    ([line("a"), line("b", product="x" * 256)], "staging_product_length"),
    ([line("a"), line("b", total="99999999999999")], "staging_required_present"),
    ([line("a"), line("b", user="99999999999")], "staging_required_present"),
])
def test_staging_is_all_or_nothing(tiny, lines, rule):
    warehouse = tiny.warehouse()
    path = tiny.text([HEADER, *lines])
    result = jobs.import_revenue(tiny.spark, warehouse, path)
    assert not result.success and rule in result.message
    assert warehouse.read_if_present("stg_revenue_import") is None
    assert warehouse.read_if_present("fact_monthly_revenue") is None


def test_dimension_upkeep(tiny):
    star = tiny.star()
    path = tiny.text([
        HEADER,
        "Apple,Apr/23,NEW000000001,p, Title ,  Ann ,,Sony Music,f,CA,1,1,50,a",
        "Apple,Apr/23,NEW000000001,p,Other,Bea,,Sony Music,f,CA,1,1,50,b",
        "Apple,Apr/23,NEW000000002,p,T,Jane,,Nobody,f,CA,1,1,2,c",
        "Apple,Apr/23,USUM71307667,p,T,Jane,,Sony Music,f,CA,1,1,2,d"])
    sheet = sheets.dimension_sheet(tiny.spark, path)
    assert rows_of(dimensions.new_artists(sheet, star)) == [(50, "Ann", D(100))]
    songs = dimensions.new_songs(sheet, star)
    assert rows_of(songs) == [("NEW000000001", "Other", 50, 1, "Released")]
    assert rows_of(dimensions.with_song_ids(songs, star.songs), "song_id") == [(5,)]
    assert rows_of(dimensions.sync_counts(star.artists, star.songs)) == [("Artists", 3), ("Songs", 4)]


def test_song_ids_are_gapless_and_follow_the_largest(tiny):
    songs = tiny.spark.range(1000).selectExpr("concat('C', id) AS isrc")
    found = rows_of(dimensions.with_song_ids(songs, tiny.star().songs), "song_id")
    assert found == [(n,) for n in range(5, 1005)]


def test_malformed_user_stops_dimension_upkeep(tiny):
    path = tiny.text([HEADER, line(user="abc")])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        dimensions.sheet_artists(sheets.dimension_sheet(tiny.spark, path)).collect()


def test_missing_countries(tiny):
    found = rows_of(dimensions.missing_countries(tiny.star().countries))
    assert len(found) == 19 and ("US", "United States", "Unknown") in found
    assert not {"CA", "DE"} & {code for code, _, _ in found}


def test_a_long_line_with_an_empty_id_is_usable(tiny, spark):
    line = 'Spotify,2025-01-01,USUM71307667,p,"Title, live",Artist,,Label,f,CA,10,7,1,'
    kept, rejected = sheets.intake_revenue(spark, tiny.text([HEADER, f"{line},extra", line.rsplit(",", 2)[0]]))
    assert rows_of(kept, "id", "song_name", "userid") == [("", "Title, live", 1)]
    assert rows_of(rejected, "fault") == [("missing field",)]


def test_files_with_another_header_order_fail_the_read(tiny, spark):
    first = tiny.text(["platform_name,revenue_share_percentage,effective_from", "Tidal,70,2025-01-01"])
    other = tiny.text(["effective_from,platform_name,revenue_share_percentage", "2025-01-01,Deezer,60"])
    for path in (first, other):
        assert sheets.intake_platforms(spark, path)[0].count() == 1
    with pytest.raises(Exception, match="header"):
        sheets.intake_platforms(spark, [first, other])[0].collect()


def test_validate_is_one_pass_and_shows_the_first_row(tiny):
    path = tiny.text([HEADER, line("z", total="abc"), line("y"), line("a")])
    checked = sheets.validate_sheet(tiny.spark, path, "revenue")
    assert '"id":"y"' in checked.first().sample
    assert checked._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    broken = tiny.text([HEADER, line("b", product='"two\nlines"'), line("a")])
    row = sheets.validate_sheet(tiny.spark, broken, "revenue", multi_line=True).first()
    assert row.rows_found == 2 and '"id":"b"' in row.sample
