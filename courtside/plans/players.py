"""Player, team and career questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maths import FREE_THROW_WEIGHT, ratio
from ..functions.text import canonical_team, extract, initials, link_slug
from ..operators.ordered import (
    DEFAULT_WIDTH, bucket_of, ordered_pass, rolling_mean, running, total,
)
from ..operators.ranking import top_dense, with_rank
from ..operators.reshape import cut, longer
from ..operators.verbs import attach, cast_except, first_per_key, separate
from ..session import stage

# fixed values: eras by first and last-but-one year, positions by listed code
ERAS = (("80s", 1985, 1995), ("90s", 1995, 2005), ("00s", 2005, 2015), ("10s", 2015, 2020))
POSITIONS = {
    "G": ("PG", "SG", "PG-SG", "SG-PG", "SG-SF"),
    "F": ("SF", "SF-SG", "SF-PF", "PF-SF", "PF"),
    "C": ("C-PF", "PF-C", "C"),
}
# fixed values: selections that replaced an injured player (year, name fragment)
REPLACEMENTS = (
    (2014, "davis"), (2015, "cous"), (2015, "korv"), (2015, "now"), (2015, "lill"),
    (2016, "horf"), (2016, "gasol"), (2017, "antho"), (2018, "george"), (2018, "drag"),
    (2018, "walk"), (2018, "drum"), (2019, "russed"), (2020, "book"), (2021, "conle"),
    (2021, "book"), (2021, "sabondo"), (2022, "balll"), (2022, "murra"), (2022, "allenja"),
)
DECADES = ((1979, 1989, 1999, 2009, 2023), ("80s", "90s", "00s", "10s"))


# ---- names and duos --------------------------------------------------------


def initials_rate(seasons: DataFrame, above: Column, min_players: int = 10) -> DataFrame:
    """Per pair of initials: players, players with a season ``above``, and the rate."""
    per_player = (
        seasons.withColumn("initials", initials(F.col("player")))
        .groupBy("initials", "player")
        .agg(F.max(F.coalesce(above, F.lit(False))).alias("_above"))
    )
    n = F.col("total_players")
    return (
        per_player.groupBy("initials")
        .agg(F.count(F.lit(1)).alias("total_players"), F.count_if("_above").alias("total_above"))
        .where((n > min_players) & (F.col("total_above") > 0))
        .withColumn(
            "rate", (F.col("total_above").cast("decimal(7,2)") / n).cast("decimal(7,2)")
        )
    )


def _tasks(spark: SparkSession, rows: int, most: int) -> int:
    """Partitions for so many rows: those of the session, fewer for a small table, more where one would hold over ``most`` rows."""
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 65536)), -(-rows // most), 1)


def duo_teams(seasons: DataFrame, min_year: int = 1990, block: int = 512, most: int = 1 << 20) -> DataFrame:
    """Every ordered pair of team-mates with the number of franchises they shared.

    The answer is the list of pairs, so pairs must be built; each unordered pair
    is built once per roster (ordered pairs come back at the end), and a large
    roster is cut into blocks joined block against block, so no task meets more
    than ``block`` x ``block`` pairs at once.

    The sizes of rosters say how many rows and pairs there will be; exchanges get
    partitions for ``most`` rows each, so a task's memory stays the same as the table grows.
    """
    spark = seasons.sparkSession
    listed = seasons.where((F.col("year") > min_year) & (F.col("team_id") != "TOT")).select(
        "player",
        canonical_team(F.col("team_id")).alias("team"),
        F.concat(canonical_team(F.col("team_id")), F.col("year").cast("string"),
                 *([F.col("squad")] if "squad" in seasons.columns else [])).alias("roster"),
    ).where(F.col("player").isNotNull() & F.col("roster").isNotNull())
    members = stage(listed.repartition(_tasks(spark, listed.count(), most), "player", "roster").distinct(), "rosters")
    sizes = members.groupBy("roster").agg(F.count(F.lit(1)).alias("_n"))
    n, blocks = F.col("_n"), F.ceil(F.col("_n") / block).cast("int")
    known = sizes.agg(F.max("_n").alias("largest"), F.sum(n * blocks).alias("copies"), F.sum(n * (n - 1) / 2).cast("long").alias("pairs")).first()
    if (known.largest or 0) > block:
        large = stage(sizes.where(n > block).select("roster", blocks.alias("_blocks")), "large_rosters")
        dealt = members.join(large, "roster", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("player"), F.col("_blocks").cast("long")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
        keys = ["roster", "_l", "_r"]
        left = dealt.select("*", own.alias("_l"), every.alias("_r"))
        right = dealt.select("*", own.alias("_r"), every.alias("_l"))
    else:
        keys, left, right = ["roster"], members, members
    pairs = known.pairs or 0
    meeting = _tasks(spark, max(known.copies or 0, pairs), most)
    met = (
        left.select(*keys, "team", F.col("player").alias("a")).repartition(meeting, *keys)
        .join(right.select(*keys, F.col("player").alias("b")).repartition(meeting, *keys), keys)
        .where(F.col("a") < F.col("b"))
        .select("a", "b", "team", F.pmod(F.xxhash64("roster"), F.lit(64)).alias("_part"))
    )
    # two who share many rosters meet in up to 64 tasks first
    once = met.repartition(_tasks(spark, pairs, most), "a", "b", "_part").distinct().select("a", "b", "team")
    counted = once.repartition(_tasks(spark, pairs, most), "a", "b").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("dis_teams"))
    text = lambda x, y: F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string"))
    return counted.select(
        F.explode(F.array(text("a", "b"), text("b", "a"))).alias("duo"), "dis_teams"
    )


def era_position_groups(seasons: DataFrame, min_minutes: float = 1000) -> DataFrame:
    """Seasons with enough minutes, labelled by era and position group."""
    year, era, pos = F.col("year"), None, None
    for name, first, end in ERAS:
        hit = (year >= first) & (year < end)
        era = F.when(hit, name) if era is None else era.when(hit, name)
    for name, codes in POSITIONS.items():
        hit = F.col("pos").isin(*codes)
        pos = F.when(hit, name) if pos is None else pos.when(hit, name)
    return (
        seasons.where(F.col("mp") > min_minutes)
        .withColumns({"group": era, "real_pos": pos})
        .dropna(subset=["group", "real_pos"])
    )


# ---- timing ----------------------------------------------------------------


def milestone_timing(
    box: DataFrame,
    rebounds: DataFrame,
    nth: int = 10,
    min_points: int = 10,
    min_assists: int = 10,
    late: float = 50,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Late n-th rebounds of games that ended on exactly n, per player.

    ``box``: player, game_id, points, rebounds, assists. ``rebounds``: player,
    game_id, id, clock.
    """
    done = (F.col("points") >= min_points) & (F.col("assists") >= min_assists)
    exact = box.where(done & (F.col("rebounds") == nth)).select("player", "game_id")
    numbered = ordered_pass(
        stage(rebounds.join(exact, ["player", "game_id"]), "milestone_rebounds"),
        ["player", "game_id"], ["id"], bucket_of("id", width), {"num_reb": running(F.lit(1))},
    ).where(F.col("num_reb") == nth)
    timing = numbered.groupBy("player").agg(
        F.count_if(F.col("clock") < late).alias("n"), F.count(F.lit(1)).alias("_all")
    )
    trips = (
        box.where(done & (F.col("rebounds") >= nth))
        .groupBy("player").agg(F.count(F.lit(1)).alias("n_total_trips"))
    )
    return (
        timing.where("n > 0")
        .withColumn("freq", ratio(F.col("n"), F.col("_all")))
        .join(trips, "player")
        .withColumn("freq_under_minute", ratio(F.col("n"), F.col("n_total_trips")))
        .drop("_all")
    )


def first_action_after_break(
    events: DataFrame, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Who takes a team's first shot around each timeout.

    ``events``: game_id, qtr, id, team_id, player, is_break, shooting, skip
    (kinds dropped before looking), miss (kinds dropped after). Timeouts are
    numbered per quarter and the number filled up, then down: a row belongs to
    the next timeout, or to the last one when none follows. The final windows
    run over one team's roster.
    """
    flag = F.col("is_break").cast("int")
    counted = ordered_pass(
        events, ["game_id", "qtr"], ["id"], bucket_of("id", width),
        {"_c": running(flag), "_t": total(flag)},
    )
    c, t = F.col("_c"), F.col("_t")
    number = F.when(F.col("is_break"), c).when(c < t, c + 1).when(t > 0, c)
    shots = counted.withColumn("num_timeout", number).where(~F.col("skip") & F.col("shooting"))
    first = first_per_key(
        shots.select("game_id", "team_id", "qtr", "num_timeout", "id", "player", "miss"),
        ["game_id", "team_id", "qtr", "num_timeout"], ["id"],
    ).where(~F.col("miss"))
    games = (
        events.select("team_id", "player", "game_id").distinct()
        .groupBy("team_id", "player").agg(F.count(F.lit(1)).alias("total_games"))
    )
    overall = events.where("shooting").groupBy("team_id", "player").agg(
        F.count(F.lit(1)).alias("fga")
    )
    team = Window.partitionBy("team_id")
    by_share = team.orderBy(F.col("pct_plays").desc(), "player")
    by_game = team.orderBy(F.col("per_game_play").desc(), "player")
    by_fga = team.orderBy(F.col("fga").desc(), "player")
    ranked_fga = overall.withColumn("rank_team_shot", F.row_number().over(by_fga)).drop("fga")
    counts = first.groupBy("team_id", "player").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.join(games, ["team_id", "player"])
        .withColumn("total_plays", F.sum("n").over(team))
        .withColumns(
            {
                "pct_plays": ratio(F.col("n"), F.col("total_plays")),
                "per_game_play": ratio(F.col("n"), F.col("total_games")),
            }
        )
        .withColumns(
            {
                "rank_in_team_per_play": F.row_number().over(by_share),
                "rank_in_team_per_game": F.row_number().over(by_game),
                "diff_1_2": F.col("pct_plays") - F.lead("pct_plays").over(by_share),
            }
        )
        .join(ranked_fga, ["team_id", "player"], "left")
        .withColumn(
            "diff_start_finish", F.col("rank_in_team_per_game") - F.col("rank_team_shot")
        )
    )


# ---- fantasy tables --------------------------------------------------------


def position_mix_by_rank_bin(
    projections: DataFrame, breaks: Sequence[float] = tuple(range(0, 121, 12)), size: int = 12
) -> DataFrame:
    """Positions per rank bin; a player listed at several counts in each."""
    long = projections.select("rank", F.explode(F.split("pos", "/")).alias("pos"))
    return (
        long.withColumn("cut_bins", cut("rank", breaks))
        .where(F.col("cut_bins").isNotNull())
        .groupBy("cut_bins", "pos")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("freq", F.col("n") / F.lit(float(size)))
    )


def projection_compare(
    ours: DataFrame, theirs: DataFrame, keys: Sequence[str] = ("name", "team", "pos")
) -> tuple[DataFrame, DataFrame]:
    """(joined rows with the value gap, both sources stacked with the gap filled in)."""
    keys = list(keys)
    both = ours.join(theirs.withColumnRenamed("value", "_other"), keys).withColumn(
        "diff", F.col("value") - F.col("_other")
    )
    gaps = both.select(*keys, "diff")
    stacked = ours.select(*keys, "value", F.lit("ours").alias("type")).unionByName(
        theirs.select(*keys, "value", F.lit("theirs").alias("type"))
    )
    return both.withColumnRenamed("_other", "other_value"), stacked.join(gaps, keys, "left")


# ---- careers ---------------------------------------------------------------


def franchise_succession(seasons: DataFrame) -> DataFrame:
    """Teams whose last year is directly followed by another team's first year."""
    spans = seasons.groupBy("team_id").agg(
        F.min("year").alias("min_year"), F.max("year").alias("max_year")
    )
    later = spans.select(
        F.col("team_id").alias("next_team"), (F.col("min_year") - 1).alias("max_year"),
        F.col("max_year").alias("next_max_year"),
    )
    return spans.join(later, "max_year").select(
        "team_id", "min_year", "max_year", "next_team", "next_max_year"
    )


def coach_player_reunions(
    seasons: DataFrame, coaches: DataFrame, succession: DataFrame | None = None, min_teams: int = 2
) -> DataFrame:
    """Per coach: players coached, and those met at two or more franchises.

    ``succession`` (team_id, next_team) is followed twice. Distinct counts are
    staged (player-team, player, coach), so a coach with very many rows is
    combined before each shuffle.
    """
    met = seasons.where(F.col("team_id") != "TOT").join(
        coaches.select("team_id", "year", "coach"), ["team_id", "year"]
    )
    if succession is not None:
        for _ in range(2):
            step = succession.select("team_id", "next_team")
            met = met.join(step, "team_id", "left").withColumn(
                "team_id", F.coalesce("next_team", "team_id")
            ).drop("next_team")
    per_player = (
        met.select("player", "coach", "team_id").distinct()
        .groupBy("player", "coach").agg(F.count(F.lit(1)).alias("total_teams"))
    )
    return (
        per_player.groupBy("coach")
        .agg(
            F.count(F.lit(1)).alias("total_players"),
            F.count_if(F.col("total_teams") >= min_teams).alias("total_players_over_2"),
        )
        .where(F.col("total_players_over_2") > 0)
        .withColumn("pct_over_2", ratio(F.col("total_players_over_2"), F.col("total_players")))
    )


def clean_coaches(raw: DataFrame) -> DataFrame:
    """Team code out of the team link, season to number."""
    return raw.withColumns(
        {
            "team_id": link_slug(F.col("team_name"), "teams"),
            "year": F.col("season").try_cast("int"),
        }
    ).drop("team_name", "season")


def overlay_rules(
    df: DataFrame, flag: str, rules: Sequence[tuple[int, str]], year: str = "year", name: str = "name"
) -> DataFrame:
    """Set a flag where a hand-kept (year, name fragment) rule applies."""
    hit = F.lit(False)
    for y, fragment in rules:
        hit = hit | ((F.col(year) == y) & F.col(name).contains(fragment))
    return df.withColumn(flag, F.when(hit, True).otherwise(F.col(flag)))


def allstar_first_time(
    selections: DataFrame, rules: Sequence[tuple[int, str]] = REPLACEMENTS
) -> DataFrame:
    """Selections with the overlay applied and the first selection marked."""
    flagged = overlay_rules(selections, "injury_replacement", rules).distinct()
    # distinct rows of one name: at most a flag and a year each
    own = Window.partitionBy("name")
    return flagged.withColumn("first_year", F.min("year").over(own)).withColumn(
        "is_first", F.col("year") == F.col("first_year")
    )


def first_share(marked: DataFrame) -> DataFrame:
    """Share of first-time selections among replacements and others."""
    return (
        marked.groupBy("injury_replacement")
        .agg(F.count_if("is_first").alias("sum_first"), F.count(F.lit(1)).alias("sum_players"))
        .withColumn("freq", ratio(F.col("sum_first"), F.col("sum_players")))
    )


def decade_means(marked: DataFrame, stats: DataFrame) -> DataFrame:
    """First-time selections by decade: age, experience and per-game means.

    ``stats``: name, year, age, mp, g, pts, start_year; with fg and fga also the share of shots made, with
    trb and ast rebounds and assists per game.
    """
    rows = marked.where("is_first").join(stats, ["name", "year"]).withColumns(
        {
            "decade": cut("year", DECADES[0], DECADES[1]),
            "exp": F.col("year") - F.col("start_year") + 1,
        }
    ).where(F.col("decade").isNotNull())
    more = {"mean_pct": ("fg", "fga"), "mean_reb": ("trb", "g"), "mean_ast": ("ast", "g")}
    more = {name: pair for name, pair in more.items() if set(pair) <= set(stats.columns)}
    summed = dict.fromkeys(["age", "exp", "mp", "g", "pts", *(c for pair in more.values() for c in pair)])
    sums = rows.groupBy("decade").agg(
        F.count(F.lit(1)).alias("num_first"),
        *[F.sum(c).alias(f"_{c}") for c in summed],
    )
    mean = lambda num, den: ratio(F.col(num), F.col(den))
    return sums.select(
        "decade", "num_first",
        mean("_age", "num_first").alias("mean_age"),
        mean("_exp", "num_first").alias("mean_exp"),
        mean("_mp", "_g").alias("mean_min"),
        mean("_pts", "_g").alias("mean_pts"),
        *[mean(f"_{a}", f"_{b}").alias(name) for name, (a, b) in more.items()],
    )


# ---- game logs -------------------------------------------------------------


def cumulative_wins(
    log: DataFrame, keys: Sequence[str], width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Game date out of the request link, numbers out of text, running wins."""
    day = F.to_date(extract(F.col("url"), r"\d{4}-\d{2}-\d{2}"))
    typed = cast_except(
        log.withColumn("game_date", day).drop("url"), [*keys, "id", "game_date"]
    )
    return ordered_pass(
        typed, keys, ["id"], bucket_of("id", width), {"num_wins": running("w")}
    )


def played_vs_missed(
    team_games: DataFrame,
    played: DataFrame,
    min_played: int = 20,
    min_missed: int = 5,
    top: int = 15,
    own: str | None = None,
    min_own: float = 0.0,
) -> DataFrame:
    """Team rate in the games a player played against those missed, best ranks.

    ``team_games``: team_id, game_date, rate; ``played``: team_id, game_date,
    player. Missed games are the team's totals minus the player's, so the
    player x date grid is never built. With ``own``, a column of ``played``, a player also needs a mean of ``min_own`` of
    it over the games played, which comes out as ``mean_own``.
    """
    per_game = played.groupBy("team_id", "game_date", "player").agg((F.avg(own) if own else F.lit(0.0)).alias("_own"))
    totals = team_games.groupBy("team_id").agg(
        F.sum("rate").alias("_sum"), F.count("rate").alias("_n")
    )
    on = (
        per_game.join(team_games, ["team_id", "game_date"])
        .groupBy("team_id", "player")
        .agg(F.sum("rate").alias("_on"), F.count("rate").alias("games_played_true"), F.avg("_own").alias("mean_own"))
    )
    missed = F.col("_n") - F.col("games_played_true")
    both = on.join(totals, "team_id").select(
        "team_id", "player", "games_played_true", missed.alias("games_played_false"),
        ratio(F.col("_on"), F.col("games_played_true")).alias("mean_true"),
        ratio(F.col("_sum") - F.col("_on"), missed).alias("mean_false"),
        *(["mean_own"] if own else []),
    )
    enough = F.col("mean_own") >= min_own if own else F.lit(True)
    kept = both.where(
        (F.col("games_played_false") >= min_missed) & (F.col("games_played_true") > min_played) & enough
    ).withColumn("on_off", F.round(F.col("mean_true") - F.col("mean_false"), 6))
    return top_dense(stage(kept, "played_vs_missed"), "on_off", top, "rank_passing")


def win_loss_shift(losses: DataFrame, wins: DataFrame) -> DataFrame:
    """Metric change from wins to losses per team, with league ranks of both."""
    tag = lambda df, s: df.withColumnsRenamed(
        {c: f"{c}_{s}" for c in df.columns if c != "team_id"}
    )
    both = stage(tag(losses, "x").join(tag(wins, "y"), "team_id"), "win_loss")
    win_ratio = ratio(F.col("potential_ast_y"), F.col("passes_made_y"))
    loss_ratio = ratio(F.col("potential_ast_x"), F.col("passes_made_x"))
    shifted = both.withColumns(
        {
            "pass_change": F.col("passes_made_x") - F.col("passes_made_y"),
            "pot_ast_change": F.col("potential_ast_x") - F.col("potential_ast_y"),
            "pass_ratio_change": F.round(loss_ratio - win_ratio, 3) * 100,
        }
    )
    ranked = with_rank(shifted, [], "passes_made_y", "rank_pass_win", "dense", True)
    return with_rank(ranked, [], "passes_made_x", "rank_pass_loss", "dense", True)


# ---- matchups --------------------------------------------------------------


def matchup_height(
    matchups: DataFrame,
    sums: Sequence[str],
    breaks: Sequence[float] = tuple(range(67, 93, 5)),
    step: int = 3,
) -> DataFrame:
    """Matchup totals by team, year and height gap (up / same / down), with the
    share of possessions and its change from the year before.

    Rates of shooting and scoring come along for whatever of fga, fgm, fg3a, fg3m, pts and team_pts is summed."""
    gap = F.col("height_off") - F.col("height_def")
    kind = F.when(gap >= step, "up").when(gap <= -step, "down").otherwise("same")
    totals = (
        matchups.withColumns({"height_bin": cut("height_off", breaks), "type_diff": kind})
        .where(F.col("height_bin").isNotNull())
        .groupBy("team_id", "year", "type_diff")
        .agg(*[F.sum(c).alias(f"sum_{c}") for c in sums])
    )
    # three rows (up, same, down) per team and year
    season = Window.partitionBy("team_id", "year")
    shared = totals.withColumns(
        {
            "freq": ratio(F.col("sum_poss"), F.sum("sum_poss").over(season)),
            "blocks_per_poss": ratio(F.col("sum_blk"), F.col("sum_poss")),
        }
    )
    total = lambda c: F.col(f"sum_{c}")
    rates = {
        "fg_pct": (("fgm", "fga"), lambda: ratio(total("fgm"), total("fga"))),
        "two_pct": (("fgm", "fga", "fg3m", "fg3a"), lambda: ratio(total("fgm") - total("fg3m"), total("fga") - total("fg3a"))),
        "three_pct": (("fg3m", "fg3a"), lambda: ratio(total("fg3m"), total("fg3a"))),
        "pts_per_poss_player": (("pts",), lambda: ratio(total("pts"), total("poss"))),
        "pts_per_poss_team": (("team_pts",), lambda: ratio(total("team_pts"), total("poss"))),
        "shot_freq": (("fga",), lambda: ratio(total("fga"), total("poss"))),
    }
    shared = shared.withColumns({name: rate() for name, (needs, rate) in rates.items() if set(needs) <= set(sums)})
    # one row per year: a team's window is as long as its number of seasons
    years = Window.partitionBy("team_id", "type_diff").orderBy("year")
    return shared.withColumn("diff_freq", F.col("freq") - F.lag("freq").over(years))


def matchup_blocks(
    matchups: DataFrame, min_poss: float = 30, step: int = 3, top: int = 100,
    keys: Sequence[str] = (), breaks: Sequence[float] = tuple(range(67, 93, 5)),
) -> DataFrame:
    """Attacker-defender pairs with a height edge for the attacker and blocked
    shots: blocks per possession, the best ``top`` rates with their dense rank.

    ``keys`` tell pairs apart further: columns of ``matchups``, or ``height_bin``, the attacker's height cut at ``breaks``."""
    pairs = (
        matchups.withColumn("height_bin", cut("height_off", breaks))
        .where((F.col("height_off") - F.col("height_def") >= step) & (F.col("blk") > 0))
        .groupBy(*keys, "off_player", "def_player")
        .agg(F.sum("blk").alias("total_blocks"), F.sum("poss").alias("total_poss"))
        .where(F.col("total_poss") >= min_poss)
        .withColumn("blocks_per_poss", ratio(F.col("total_blocks"), F.col("total_poss")))
    )
    return top_dense(stage(pairs, "matchup_pairs"), "blocks_per_poss", top, "rank_blk")


RATES = {
    "pts": ("total_pts", "total_poss"), "fga": ("total_fga", "total_poss"),
    "teampts": ("total_team_pts", "total_poss"), "pct": ("total_fgm", "total_fga"),
    "ast": ("total_ast", "total_poss"), "tov": ("total_tov", "total_poss"),
    "fta": ("total_fta", "total_poss"), "ts": ("total_pts", "ts_shot_att"),
    "ts_att": ("ts_shot_att", "total_poss"),
    "fg3a": ("total_fg3a", "total_poss"), "fg3m": ("total_fg3m", "total_poss"),
}


def defender_effect(matchups: DataFrame, flag: str = "best_defender") -> DataFrame:
    """Rates of each player against flagged and other defenders, and the gaps.

    The gap window holds the two rows of a player. Three-point rates come along where fg3a and fg3m are there.
    """
    threes = [c for c in ("fg3a", "fg3m") if c in matchups.columns]
    cols = ("poss", "pts", "team_pts", "fga", "fgm", "ast", "tov", "fta", *threes)
    totals = matchups.groupBy("player", flag).agg(
        *[F.sum(c).alias(f"total_{c}") for c in cols]
    ).withColumn(
        "ts_shot_att", 2 * (F.col("total_fga") + FREE_THROW_WEIGHT * F.col("total_fta"))
    )
    rates = {n: of for n, of in RATES.items() if n not in ("fg3a", "fg3m") or n in threes}
    rated = totals.withColumns(
        {f"{n}_rate": ratio(F.col(a), F.col(b)) for n, (a, b) in rates.items()}
    )
    pair = Window.partitionBy("player").orderBy(flag)
    return rated.withColumns(
        {f"{n}_prev": F.col(f"{n}_rate") - F.lag(f"{n}_rate").over(pair) for n in rates}
    )


def flag_listed(df: DataFrame, listed: DataFrame, key: str, flag: str) -> DataFrame:
    """Whether the row's key is on a list."""
    marks = listed.select(key).distinct().withColumn("_listed", F.lit(True))
    return df.join(marks, key, "left").withColumn(flag, F.col("_listed").isNotNull()).drop("_listed")


def rolling_form(
    box: DataFrame,
    keys: Sequence[str],
    k: int = 6,
    min_points: float | None = None,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Rolling means against an opponent and the rows with the best rolling rate.

    ``box``: keys, id, points, fga, fgm and, when wanted, rebounds and assists.
    """
    stats = [c for c in ("points", "rebounds", "assists", "fga", "fgm") if c in box.columns]
    numbered = ordered_pass(
        box.where(F.col("points").isNotNull()), keys, ["id"], bucket_of("id", width),
        {"pos": running(F.lit(1))},
    )
    rolled = rolling_mean(
        numbered, keys, "pos", {f"roll_mean_{c}": c for c in stats}, k, width
    ).withColumn("roll_mean_pct", ratio(F.col("roll_mean_fgm"), F.col("roll_mean_fga")))
    best = attach(stage(rolled, "rolling"), keys, max_pct=F.max("roll_mean_pct")).where(
        F.col("roll_mean_pct") == F.col("max_pct")
    )
    return best if min_points is None else best.where(F.col("roll_mean_points") >= min_points)


def with_without_teammate(box: DataFrame, player: int, teammate: int) -> DataFrame:
    """One player's mean minutes by whether a team-mate played and the result."""
    mate = box.where(F.col("player") == teammate).select(
        "game_id", F.col("minutes").alias("_mate")
    )
    return (
        box.where(F.col("player") == player)
        .join(mate, "game_id", "left")
        .groupBy(F.col("_mate").isNull().alias("missing"), "team_winner")
        .agg(F.avg("minutes").alias("mean_minutes"), F.count(F.lit(1)).alias("n"))
    )


# ---- team tables and dictionaries ------------------------------------------


def contest_effect(
    hustle: DataFrame, advanced: DataFrame, opponent: DataFrame, slugs: DataFrame
) -> DataFrame:
    """Three text tables of a team joined, cast, and turned into defensive rates."""
    key = ["team_id", "team_name"]
    joined = (
        hustle.join(advanced, key, "left").join(opponent, key, "left")
        .join(slugs, "team_name", "left")
    )
    typed = cast_except(joined, ["team_id", "team_name", "slug"])
    threes, shots = F.col("opp_fg3a"), F.col("opp_fga")
    return first_per_key(typed, ["team_name"], ["team_id"]).select(
        "team_name", "slug", "opp_fg3_pct", "def_rating",
        ratio(F.col("contested_3pt"), threes).alias("pct_three_contested"),
        ratio(F.col("contested_2pt"), shots - threes).alias("pct_two_contested"),
        ratio(threes, shots).alias("freq_3pt"),
        ratio(F.col("opp_fgm") + 0.5 * F.col("opp_fg3m"), shots).alias("opp_efg"),
        ratio(F.col("deflections"), F.col("pace"), 100).alias("deflections_per_100"),
    )


def draft_clean(
    draft: DataFrame, headers: Sequence[str] = ("Player", "Round 2"), drop: str = "Minnesota"
) -> DataFrame:
    """Draft rows without repeated headers, with the player id of the link."""
    rows = draft.where(~F.col("player").isin(list(headers)) & ~F.col("seasons").rlike(drop))
    pieces = ["_a", "_b", "_c", "real_name"]
    return separate(rows, "link", pieces, "[^A-Za-z0-9]+").drop("_a", "_b", "_c")


def id_dictionary(pages: DataFrame) -> DataFrame:
    """(name, pos, id) out of "name, pos" cells and their links."""
    split_up = separate(pages.select("cell", "link").distinct(), "cell", ["name", "pos"], ",")
    return split_up.withColumn("id", extract(F.col("link"), "[0-9]{1,12}"))
