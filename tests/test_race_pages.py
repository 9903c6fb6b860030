"""Result, meeting and profile pages rebuilt in memory, with what must come of them."""

from datetime import date

from pyspark.sql import functions as F

from formline.sources import race_pages

TITLES = ["Pla.", "Horse No.", "Horse", "Jockey", "Trainer", "Act. Wt.", "Declar. Horse Wt.", "Dr.", "LBW", "Running Position", "Finish Time", "Win Odds"]


def row(*cells, tag="td"):
    return "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"


def runner(pos, no, name, horse, jockey, trainer, *rest):
    return row(pos, no, f'<a href="/horse?HorseId={horse}&x=1">{name}</a>&nbsp;({horse[-4:]})', f"<a href='/j?JockeyId={jockey}'>J {jockey}</a>", f"<a href=/t?TrainerId={trainer}>T {trainer}</a>", *rest)


RACE = (
    "<html><body><select id='selectId'><option>03/06/2026</option><option selected>31/05/2026</option><option>none</option></select>"
    "<select id='other'><option>01/01/2020</option></select><div class='x js_racecard'>Wednesday, <b>Happy Valley</b></div>"
    "<table><tr><td>menu</td></tr></table>"
    "<table>" + row("RACE 1 (745)", "", "") + row("Class 5 - 1650M - (40-0)", "Going :", "GOOD TO FIRM") + row("EXAMPLE HANDICAP", "Course :", 'TURF - "C" Course') + row("HK$ 875,000", "Time :", "(27.5)") + "</table>"
    "<table class='f_tac'>" + row(*TITLES, tag="th")
    + runner("1", "3", "FAMILY FORTUNE", "HK_2022_H447", "MOJ", "FC", "133", "995", "1", "-", "5 5 4 1", "1:38.85", "2.7")
    + runner("2 DH", "7", "SECOND", "HK_2021_G001", "ABC", "XY", "120", "1,100", "4", "1-1/4", "1 1 1 2", "1:39.05", "1,020.5")
    + row("WV", "", "Withdrawn (H001)", *[""] * 9) + row("3", "9", "OLD STYLE (C123)", "K Name", "S Name", *[""] * 7) + "</table>"
    "<table>" + row("Dividend") + row("Pool", "Winning Combination", "Dividend (HK$)") + row("WIN", "3", "27.00") + row("PLACE", "3", "13.50") + row("7", "55.0") + row("", "9", "1,020.50") + row("QUINELLA", "3,7", "Refund") + row("TRIO", "3,7,9", "99.0") + "</table></body></html>"
)


def one(spark, html, make, **how):
    return make(spark.createDataFrame([(1, html), (2, None), (3, "<table><tr>")], "id int, html string"), "html", ["id"], **how)


def test_runners_by_their_titles(spark):
    got = one(spark, RACE, race_pages.runner_rows).orderBy("saddle").collect()
    first, second, third = got
    assert (first.id, first.finish_pos, first.saddle, first.horse_id, first.horse_name, first.jockey_code, first.jockey_name, first.trainer_code, first.trainer_name) == (1, 1, 3, "HK_2022_H447", "FAMILY FORTUNE", "MOJ", "J MOJ", "FC", "T FC")
    assert (first.actual_weight, first.declared_weight, first.draw, first.finish_time_s, first.win_odds, first.running_position_raw, first.dead_heat) == (133, 995, 1, 98.85, 2.7, "5 5 4 1", False)
    assert (second.finish_pos, second.dead_heat, second.declared_weight, second.win_odds, second.lbw_raw) == (2, True, 1100, 1020.5, "1-1/4")
    assert (third.horse_name, third.horse_id, third.jockey_code, third.jockey_name, third.win_odds, third.lbw_raw) == ("OLD STYLE", None, None, "K Name", None, None)


def test_titles_lead_whatever_their_order(spark):
    swapped = "<table>" + row("Win Odds", "Pla.", "Horse", "Horse No.") + row("4.5", "1", "ANY", "2") + "</table>"
    r = one(spark, swapped, race_pages.runner_rows).first()
    assert (r.win_odds, r.finish_pos, r.horse_name, r.saddle, r.draw) == (4.5, 1, "ANY", 2, None)


def test_race_header(spark):
    got = {r.id: r for r in one(spark, RACE, race_pages.races).collect()}
    r = got[1]
    assert (r.race_index, r.race_class, r.distance_m, r.rating_band, r.race_name, r.prize_hkd) == (745, "Class 5", 1650, "40-0", "EXAMPLE HANDICAP", 875000)
    assert (r.going, r.course, r.rail, r.surface, r.final_time_s) == ("GOOD TO FIRM", 'TURF - "C" Course', "C", "TURF", 98.85)
    assert all(v is None for k, v in got[2].asDict().items() if k != "id") and all(v is None for k, v in got[3].asDict().items() if k != "id")


def test_payouts_carry_their_pool(spark):
    got = one(spark, RACE, race_pages.payout_rows).select("pool", "combination", "dividend").collect()
    assert sorted(map(tuple, got)) == [("PLACE", "3", 13.5), ("PLACE", "7", 55.0), ("PLACE", "9", 1020.5), ("TRIO", "3,7,9", 99.0), ("WIN", "3", 27.0)]


def test_meetings(spark):
    assert sorted(r.race_date for r in one(spark, RACE, race_pages.meeting_dates).collect()) == [date(2026, 5, 31), date(2026, 6, 3)]
    assert {(r.id, r.venue, r.n_races) for r in one(spark, RACE, race_pages.meetings).collect()} == {(1, "HV", 1), (2, None, 0), (3, None, 0)}
    page = "<p>Sha Tin</p>" + "<table class='a result b'><tr><td>RACE 1 (1)</td></tr></table>" * 9 + "<table class='results'></table>"
    assert tuple(one(spark, page, race_pages.meetings).where("id = 1").first())[1:] == ("ST", 9)


def pairs(*items):
    return "<table class='table_eng_text x'>" + "".join(row(k, ":", v) for k, v in items) + "</table>"


HORSE = (
    "<title>FAMILY FORTUNE - Horse</title>" + pairs(("Country of Origin / Age", "NZ / 5"), ("Colour / Sex", "Bay / Gelding"), ("Import Type", "PPG"), ("Season Stakes*", "$1,885,625"), ("Total Stakes*", "$2,205,000"))
    + pairs(("Owner", "Tony Example"), ("Current Rating", "43"), ("Start of Season Rating", "27"), ("Sire", "Derryn"), ("Dam", "Waiana Gold"), ("Dam's Sire", "Gold Centre"))
    + "<table class='bigborder'>" + row("Race Index", "Pla.", "Date", "RC/Track/ Course", "Dist.", "G", "Race Class", "Dr.", "Rtg.", "Trainer", "Jockey", "LBW", "Win Odds", "Act. Wt.", "Running Position", "Finish Time", "Declar. Horse Wt.", "Gear", "Video Replay")
    + row("25/26 Season") + row("745", "01", "03/06/26", 'HV / Turf / "C"', "1650", "GF", "5", "1", "37", "<a href='?trainerid=FC'>C F</a>", "<a href='?jockeyid=MOJ'>J M</a>", "-", "2.7", "133", "5 5 4 1", "1.38.85", "995", "TT", "")
    + row("701", "WX", "1/6/26", "ST / AWT", *[""] * 15) + row("", "", "", "", "", "") + "</table>"
)


def test_horses(spark):
    r = one(spark, HORSE, race_pages.horse_profiles, as_of=F.lit("2026-06-15").cast("date")).where("id = 1").first()
    assert (r.name, r.country_of_origin, r.age, r.birth_year, r.colour, r.sex, r.import_type, r.sire, r.dam, r.dams_sire) == ("FAMILY FORTUNE", "NZ", 5, 2021, "Bay", "Gelding", "PPG", "Derryn", "Waiana Gold", "Gold Centre")
    assert (r.owner, r.current_rating, r.last_rating, r.season_start_rating, r.season_stakes, r.total_stakes) == ("Tony Example", 43, None, 27, 1885625, 2205000)
    retired = one(spark, pairs(("Country of Origin", "NZ"), ("Last Rating", "56"), ("Colour / Sex", "Brown")), race_pages.horse_profiles, as_of=F.lit("2026-06-15").cast("date")).where("id = 1").first()
    assert (retired.country_of_origin, retired.age, retired.birth_year, retired.current_rating, retired.last_rating, retired.colour, retired.sex) == ("NZ", None, None, None, 56, "Brown", None)


def test_form(spark):
    a, b = one(spark, HORSE, race_pages.form_rows).orderBy("row_no").collect()
    assert (a.race_index, a.finish_pos, a.run_date, a.venue, a.track, a.course, a.distance_m, a.going, a.race_class, a.draw, a.rating) == (745, 1, date(2026, 6, 3), "HV", "Turf", "C", 1650, "GF", "5", 1, 37)
    assert (a.jockey_code, a.trainer_code, a.win_odds, a.actual_weight, a.declared_weight, a.gear, a.finish_time_s) == ("MOJ", "FC", 2.7, 133, 995, "TT", 98.85)
    assert (b.race_index, b.finish_pos, b.finish_pos_raw, b.run_date, b.venue, b.track, b.course, b.win_odds) == (701, None, "WX", date(2026, 6, 1), "ST", "AWT", None, None)


def test_people(spark):
    page = "<table>" + row("J Example", "Age: 33") + "</table><table class='table_bd'>" + row("25/26 Season (up to Meeting of 03/06/2026)") + row("Nationality", ": AUS", "No. of Wins", ": 101") + row("No. of 2nds", ": 90", "Total Rides", ": 1,000") + row("Win %", ": 10.1%", "Stakes won", ": $12,345,678") + "</table>"
    r = one(spark, page, race_pages.person_profiles).where("id = 1").first()
    assert (r.name, r.age, r.nationality, r.season, r.up_to_date) == ("J Example", 33, "AUS", "25/26", date(2026, 6, 3))
    assert (r.wins, r.seconds, r.thirds, r.total_starts, r.stakes, r.win_pct) == (101, 90, None, 1000, 12345678, 10.1)


def test_page_jobs_shuffle_nothing(spark):
    for make in (race_pages.runner_rows, race_pages.payout_rows, race_pages.race_headers, race_pages.form_rows, race_pages.person_profiles):
        assert "Exchange" not in one(spark, RACE, make)._jdf.queryExecution().executedPlan().toString()
