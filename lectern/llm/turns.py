"""Speech transcripts into clean, ordered speaker turns.

Fields are taken from label and text by SQL expressions, unlabelled segments are filled forward by windows, marked noise
is removed and consecutive segments are joined by gaps-and-islands identifiers. Each segment's text is taken apart once; labels are resolved once
per lecture and spelling. Windows run over (lecture, time shard), so a recording that holds a third of all rows is spread over its shards; only one row per shard,
and the keys (no texts) of the first and last island of a shard, are looked at along a whole lecture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import latest, materialize

#: What stands for no speaker.
NO_SPEAKER = ["", "?", "-", "n/a", "na", "none", "null", "unknown", "unknown speaker", "unidentified", "string"]
TIMESTAMP = r"(?:[\[\(<]\s*\d{1,2}(?::\d{2}){1,2}(?:[.,]\d{1,3})?\s*[\]\)>]|\d{1,2}(?::\d{2}){1,2}(?:[.,]\d{1,3})?\s*(?:-->|-)(?:\s*\d{1,2}(?::\d{2}){1,2}(?:[.,]\d{1,3})?)?)"
#: Square, curly and angle brackets, asterisks and notes always mark sound, however long; round ones where they begin with a word for it.
SOUND = (
    r"\[[^\[\]\n]*\]|\{[^{}\n]*\}|<[^<>\n]*>|\*[^*\n]+\*|[♪♫]"
    r"|\((?i:inaudible|unclear|laugh\w*|sigh\w*|cough\w*|applause|music|noise|pause|silence|crosstalk|rires|risas|beifall)[^()\n]*\)"
)
HESITATION = r"(?:u+h+m*|e+r+m+|a+h+m*|ä+h+m*|ö+h+m*|e+u+h+|e+h+m*|h+m+|mm+-?hm+|mhm|uhm)"
#: These are words in German or Portuguese: there they count as hesitation only before a comma or dots.
HESITATION_OR_WORD = r"(?:um+|er)"
NAME = r"(?:(?i:speaker|spk)[\s_#-]*\d+|(?:(?i:dr|prof)\.?\s+)?\p{L}[\p{L}'’.-]*(?:\s\p{L}[\p{L}'’-]*){0,2})"
#: A letter that no hesitation sound has, before any bracket: there is speech, whatever else.
SURELY_SPEECH = r"^[^\[\](){}<>*♪♫]*?[\p{L}&&[^uhmeraäöUHMERAÄÖ]]"
VOICE = rf"(?:\n\s*(?:>>\s*)?|\s>>\s*|\s--\s+)(?={NAME}\s*:)"
TITLE = r"^(?:dr|prof|professor|mr|mrs|ms)\.?\s+"


def _label_key(label: Column) -> Column:
    """Lower case, without bracketed remarks and punctuation; 'last, first' as 'first last'."""
    k = F.lower(label)
    k = F.regexp_replace(k, r"\[[^\]]*\]|\([^)]*\)|[:<>\[\]]", " ")
    k = F.regexp_replace(k, r"^\s*([^,]+?)\s*,\s*([^,]+?)\s*$", "$2 $1")
    return F.trim(F.regexp_replace(k, r"[\s_#]+", " "))


def _roster(speakers: Column) -> Column:
    """Each name of a roster with its number, or its first name and surname, taken apart once per lecture."""

    def parts(x: Column) -> Column:
        bare = F.regexp_replace(_label_key(x), TITLE, "")
        return F.struct(x.alias("name"), F.regexp_extract(bare, r"^speaker[\s-]*0*(\d+)$", 1).alias("number"),
                        F.regexp_extract(bare, r"^(\S+)\s", 1).alias("first"), F.regexp_extract(bare, r"(\S+)$", 1).alias("last"))

    return F.transform(F.filter(speakers, lambda x: x.isNotNull()), parts)


def resolve_speakers(labels: DataFrame, roster: str) -> DataFrame:
    """``labels`` (with ``label`` and the array ``roster``) and ``name``: the roster's spelling of the label, or null.

    Numbers must be equal; surnames may differ by two edits, the nearest wins, and of equally near ones the first by name.
    """
    x = labels.withColumn("__key", F.regexp_replace(_label_key(F.col("label")), TITLE, ""))
    x = x.withColumn("__number", F.regexp_extract("__key", r"^(?:speaker|spk|sp|s)[\s-]*0*(\d+)$", 1)).withColumn("__last", F.regexp_extract("__key", r"(\S+)$", 1))
    x = x.withColumn("__first", F.regexp_replace(F.regexp_extract("__key", r"^(\S+)\s", 1), r"\.$", ""))
    number, first, last = F.col("__number"), F.col("__first"), F.col("__last")

    def score(r: Column) -> Column:
        edits = F.levenshtein(last, r["last"])
        given = F.when((first == "") | (r["first"] == ""), F.lit(1)).when(F.length(first) == 1, F.when(F.substring(r["first"], 1, 1) == first, 0).otherwise(4)).otherwise(F.least(F.levenshtein(first, r["first"]), F.lit(4)))
        ok = F.when(number != "", r["number"] == number).otherwise((r["number"] == "") & (edits <= F.when(F.length(last) >= 5, 2).otherwise(0)))
        return F.when(ok, F.struct((edits * 10 + given).alias("score"), r["name"].alias("name")))

    usable = F.col("label").isNotNull() & ~F.lower(F.trim("label")).isin(NO_SPEAKER) & (F.col("__key") != "")
    best = F.array_min(F.filter(F.transform(roster, score), lambda r: r.isNotNull()))
    return x.withColumn("name", F.when(usable, best["name"])).drop("__key", "__number", "__first", "__last")


def clean_speech(text: Column, language: Column) -> Column:
    """Without timestamps, sound marks, hesitations and repeated words."""
    t = F.regexp_replace(text, TIMESTAMP, " ")
    t = F.regexp_replace(t, SOUND, " ")
    t = F.regexp_replace(t, rf"(?iU)(?<![\p{{L}}\p{{N}}-]){HESITATION}(?![\p{{L}}\p{{N}}-])(?:\.{{2,3}}|,)?", " ")
    word_too = F.lower(F.coalesce(language, F.lit(""))).rlike("^(de|ger|pt|por|und|unk|n/a|xx|string|\\s*$)")
    t = F.when(word_too, F.regexp_replace(t, rf"(?iU)(?<![\p{{L}}\p{{N}}-]){HESITATION_OR_WORD}(?:\.{{2,3}}|,)", " ")).otherwise(
        F.regexp_replace(t, rf"(?iU)(?<![\p{{L}}\p{{N}}-]){HESITATION_OR_WORD}(?![\p{{L}}\p{{N}}-])(?:\.{{2,3}}|,)?", " "))
    t = F.regexp_replace(t, r"\s+", " ")
    t = F.regexp_replace(t, r"(?iU)(?<![\p{L}\p{N}'-])([\p{L}\p{N}'’-]+)(?: \1(?![\p{L}\p{N}'’-]))+", "$1")
    return F.trim(F.regexp_replace(t, r" ([,.;:!?])", "$1"))


def has_speech(text: Column) -> Column:
    """Whether anything but timestamps, sound marks and hesitation sounds is said."""
    t = F.regexp_replace(F.regexp_replace(text, TIMESTAMP, " "), SOUND, " ")
    t = F.regexp_replace(t, rf"(?iU)(?<![\p{{L}}\p{{N}}-])(?:{HESITATION}|{HESITATION_OR_WORD})(?![\p{{L}}\p{{N}}-])", " ")
    return F.when(text.rlike(SURELY_SPEECH), True).otherwise(t.rlike(r"[\p{L}\p{N}]"))


def _shard(start: Column, seconds: int) -> Column:
    """Time shard; null first, NaN and values beyond reason last, as they sort."""
    return F.when(start.isNull(), F.lit(-(2**40))).when(F.isnan(start) | (F.abs(start) > 1e12), F.lit(2**40)).otherwise(F.floor(start / seconds)).cast("long")


def voices(segments: DataFrame, lectures: DataFrame, shard_seconds: int) -> DataFrame:
    """One row per voice of each segment that holds speech, with its resolved speaker or null; written to the shared folder."""
    held = latest(segments, ["lecture_id", "segment_index"], ["start_seconds", "speaker", "language", "text", "is_unclear"])
    held = held.where(F.col("lecture_id").isNotNull()).withColumn("__shard", _shard(F.col("start_seconds"), shard_seconds))
    body = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), rf"^\s*{TIMESTAMP}\s*", "")
    several = F.contains(F.col("__body"), F.lit(">>")) | F.contains(F.col("__body"), F.lit("--")) | F.contains(F.col("__body"), F.lit("\n"))
    rows = held.withColumn("__body", body).select("*", F.posexplode(F.when(several, F.split("__body", VOICE)).otherwise(F.array("__body"))).alias("__piece", "__said"))
    rows = rows.withColumn("__told", F.regexp_extract("__said", rf"^\s*(?:>>\s*)?(?:[\[<]\s*({NAME})\s*[\]>]\s*[:-]?|({NAME})\s*(?::|\s-\s)\s*)", 0))
    told = F.when(F.col("__told") != "", F.regexp_replace("__told", r"^\s*>>|[:\s-]+$", ""))
    own = F.when(F.col("__piece") == 0, F.col("speaker"))
    pieces = materialize(rows.select("lecture_id", "__shard", "start_seconds", "segment_index", "__piece", "language", "__said", F.length("__told").alias("__prefix"), told.alias("__told"), own.alias("__own"),
                                     F.coalesce("is_unclear", F.lit(False)).alias("__unclear")), "speech")
    # labels are resolved once per lecture and spelling, and come back to each shard as a map of the few spellings it holds
    used = pieces.select("lecture_id", "__shard", F.explode(F.array("__told", "__own")).alias("label")).where(F.col("label").isNotNull()).distinct()
    rosters = lectures.groupBy("lecture_id").agg(F.max("speakers").alias("speakers")).select("lecture_id", _roster(F.col("speakers")).alias("__roster"))
    names = resolve_speakers(used.select("lecture_id", "label").distinct().join(rosters, "lecture_id"), "__roster").where(F.col("name").isNotNull()).select("lecture_id", "label", "name")
    names = used.join(names, ["lecture_id", "label"]).groupBy("lecture_id", "__shard").agg(F.map_from_entries(F.collect_list(F.struct("label", "name"))).alias("__names"))
    rows = pieces.join(names, ["lecture_id", "__shard"], "left").withColumn("__told", F.try_element_at("__names", "__told")).withColumn("__own", F.try_element_at("__names", "__own"))
    rows = rows.withColumn("__said", F.when(F.col("__told").isNotNull(), F.expr("substring(__said, __prefix + 1)")).otherwise(F.col("__said"))).where(has_speech(F.col("__said")))
    at = F.struct(F.col("start_seconds").alias("start"), F.col("segment_index").alias("segment"), F.col("__piece").alias("piece")).alias("__at")
    return materialize(rows.select("lecture_id", "__shard", at, F.coalesce("__told", "__own").alias("__speaker"), "language", "__said", "__unclear"), "voices")


def speaker_turns(segments: DataFrame, lectures: DataFrame, shard_seconds: int = 1800, texts: bool = True) -> DataFrame:
    """Turns: ``lecture_id, turn_start, first_segment, last_segment, speaker, unclear_segments, segments`` and, unless ``texts`` is false, ``text``.

    ``segments`` needs lecture_id, segment_index, start_seconds, speaker, language, text, is_unclear, ingested_at;
    ``lectures`` needs lecture_id, speakers; further columns are ignored. Of repeated segments the latest holds. Order is
    start_seconds (null first, NaN last), then segment_index, then voice within the segment. Segments without speech (null
    and empty texts too) are left out and end no turn; an untold speaker continues the turn before, and is null where
    there is none or the lecture has no roster. Rows without lecture_id are left out. A text of any length is one row.
    An empty table gives no turns.
    """
    said = voices(segments, lectures, shard_seconds)
    along_shards = Window.partitionBy("lecture_id").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = said.groupBy("lecture_id", "__shard").agg(F.max_by(F.col("__speaker"), F.when(F.col("__speaker").isNotNull(), F.col("__at"))).alias("last_told"))
    carried = carried.select("lecture_id", "__shard", F.last("last_told", ignorenulls=True).over(along_shards).alias("__carried"))
    w = Window.partitionBy("lecture_id", "__shard").orderBy("__at")
    rows = said.join(carried, ["lecture_id", "__shard"])
    rows = rows.withColumn("__who", F.coalesce(F.last("__speaker", ignorenulls=True).over(w), F.col("__carried")))
    before = F.lag("__who").over(w)
    rows = rows.withColumn("__first", F.row_number().over(w) == 1).withColumn("__new", F.when(F.col("__first") | ~before.eqNullSafe(F.col("__who")), 1).otherwise(0))
    rows = rows.withColumn("__island", F.sum("__new").over(w))
    cleaned = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", clean_speech(F.col("__said"), F.col("language")).alias("t")))), lambda x: x["t"]), " ").alias("text")
    islands = rows.groupBy("lecture_id", "__shard", "__island").agg(
        F.min("__at").alias("a"), F.max("__at").alias("b"), F.first("__who").alias("speaker"), F.max(F.col("__first") & F.col("__carried").eqNullSafe(F.col("__who"))).alias("goes_on"),
        F.count("*").alias("segments"), F.sum(F.col("__unclear").cast("long")).alias("unclear_segments"), *[cleaned] * texts,
    )
    islands = materialize(islands.withColumn("__last", F.max("__island").over(Window.partitionBy("lecture_id", "__shard"))), "islands")
    edge = (F.col("__island") == 1) | (F.col("__island") == F.col("__last"))
    # along a lecture go only the keys of its shards' first and last islands; what belongs to a chain is then summed up for each of them
    chain = Window.partitionBy("lecture_id").orderBy("__shard", "__island")
    new_chain = ~(F.col("goes_on") & (F.col("__island") == 1)) | (F.row_number().over(chain) == 1)
    numbered = islands.where(edge).select("lecture_id", "__shard", "__island", "goes_on").withColumn("__chain", F.sum(new_chain.cast("int")).over(chain)).drop("goes_on")
    edges = islands.where(edge).join(numbered, ["lecture_id", "__shard", "__island"])
    joined = edges.groupBy("lecture_id", "__chain").agg(
        F.min("a").alias("a"), F.max("b").alias("b"), F.first("speaker").alias("speaker"), F.sum("segments").alias("segments"), F.sum("unclear_segments").alias("unclear_segments"),
        *[F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "text"))), lambda x: x["text"]), " ").alias("text")] * texts)
    cols = ["lecture_id", F.col("a.start").alias("turn_start"), F.col("a.segment").alias("first_segment"), F.col("b.segment").alias("last_segment"), "speaker", *["text"] * texts, "unclear_segments", "segments"]
    return islands.where(~edge).select(*cols).unionByName(joined.select(*cols))
