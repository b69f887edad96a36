"""The educational value score and its parts, as column expressions over game features."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def structure(header_hits: Column, plies: Column, has_result: Column) -> Column:
    return F.least(F.least(header_hits * 2.0, F.lit(12.0)) + F.when(has_result, 4.0).otherwise(0.0) + F.least(plies / 40.0 * 4, F.lit(4.0)), F.lit(20.0))


def annotations(density: Column, words: Column, keyword_hits: Column) -> Column:
    return F.least(density * 70, F.lit(18.0)) + F.least(words / 22.0, F.lit(14.0)) + F.least(keyword_hits * 1.95, F.lit(13.0))


def humanness(elo_hits: Column, has_event: Column, year: Column, plies: Column) -> Column:
    modern = F.when(F.coalesce(year, F.lit(0)) >= 1980, 3.0).otherwise(0.0)
    return F.least(elo_hits * 3 + F.when(has_event, 4.0).otherwise(0.0) + modern + F.least(plies / 60.0 * 5, F.lit(5.0)), F.lit(20.0))


def game_type(words: Column, density: Column, plies: Column) -> Column:
    return F.when(words < 5, "database_dump").when((density >= 0.2) | (words > 150), "annotated_game").when(plies < 20, "position_study").otherwise("complete_game")


def score(parts: Column, noise: Column, words: Column, density: Column, plies: Column, variation_plies: Column) -> tuple[Column, Column, Column]:
    """(score, type, reason of a zero score) from the sum of the parts.

    Penalties: engine noise, and variations longer than the game with little prose. Gates: 1.5 words a ply at most
    gives 0; no variation with 3.5 words a ply at most gives 0, else costs 15.
    """
    ratio = variation_plies / F.greatest(plies, F.lit(1))
    wide = F.when((ratio > 1.0) & (words < 110), F.least((ratio - 1.0) * 10.0, F.lit(10.0))).otherwise(0.0)
    zero = F.lit(0.0)
    evs = F.greatest(parts + 25 - noise - wide, zero)
    evs = F.least(F.when(plies < 10, F.greatest(evs - 10, zero)).otherwise(evs), F.lit(100.0))
    evs = F.when((words < 65) & (density < 0.22), F.least(evs, F.lit(79.0))).otherwise(evs)
    wpm = words / F.greatest(plies, F.lit(1))
    thin, flat = wpm <= 1.5, (variation_plies == 0) & (wpm <= 3.5)
    evs = F.when(thin | flat, zero).when(variation_plies == 0, F.greatest(evs - 15, zero)).otherwise(evs)
    kind = F.when(thin, "low_density").when(flat, "no_variations").otherwise(game_type(words, density, plies))
    reason = F.when(thin, "Low WPM (< 1.5)").when(flat, "No Variations & Low WPM")
    return evs, kind, reason


def tier(evs: Column) -> Column:
    return F.when(evs >= 70, "high").when(evs >= 45, "medium").otherwise("low")


def source_type(name: Column) -> Column:
    """Source class of a lower-cased event and file name; the first rule that fits."""
    def has(*words: str) -> Column:
        out = F.lit(True)
        for w in words:
            out = out & F.contains(name, F.lit(w))
        return out

    return (
        F.when(has("modern chess") | has("mcm"), "modern_chess_course")
        .when(has("chessable"), "chessable_course")
        .when(has("mega", "database"), "mega_database")
        .when(has("powerbase"), "powerbase")
        .when(has("magazine") | has("cbm"), "chessbase_magazine")
        .when(has("theory", "update"), "theory_update")
        .otherwise("course_material")
    )


def game_role(place: Column, text: Column) -> Column:
    """Role by chapter and section name (lower case) and number of comments."""
    opening = place.rlike("introduction|welcome|quickstart")
    return F.when(opening, "introduction").when(F.regexp_count(text, F.lit(r"\{")) > 10, "key_annotated").otherwise("model_game")


def move_drop(side: Column, before: Column, after: Column) -> Column:
    """Pawns lost by the mover; evaluations in centipawns for White."""
    return F.when(side == "white", before - after).otherwise(after - before) / 100.0


def position_nag(cp: Column, mate: Column) -> Column:
    """Evaluation glyph of a position."""
    return (
        F.when(mate, F.when(cp > 0, 18).otherwise(19)).when(cp > 200, 18).when(cp < -200, 19).when(cp > 100, 16).when(cp < -100, 17).when(cp > 50, 14).when(cp < -50, 15).otherwise(11)
    )


def move_nag(drop: Column, miss: Column) -> Column:
    """4 for a miss (a drop over 0.75) or a drop over 1.0, 2 for one over 0.3, else null."""
    return F.when(miss | (drop > 1.0), 4).when(drop > 0.3, 2)
