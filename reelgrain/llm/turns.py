"""Speech transcripts into clean, ordered speaker turns, with SQL expressions and windows.

Labels are replaced by marks that carry the normalised speaker; a segment is cut at its marks; speakers are filled
forward over the video; what is left after removing clock times, sound annotations and hesitation sounds is speech; and
consecutive speech of one speaker is a turn (gaps and islands over the stretches that hold speech).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrain.llm.records import placed_segments
from reelgrain.llm.visual_form import form

# The words that labels are made of.
PROFESSOR = "교수님?|강사님?|선생님|professor|prof\\.?|instructor|lecturer"
ASSISTANT = "조교님?|튜터님?|teaching assistant|assistant|tutor|ta"
STUDENT = "학생|수강생|student|stud|s"
VOICE = "화자|발화자|speaker|spk"
SURNAMES = "강고곽구권김나남노도류마문민박방배백변서석선설성소손송신심안양엄여염오옥우원유육윤이임장전정조주지진차채천최추탁하한함허현홍황"
CLOCK = r"(?:\[\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?\]|\(\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?\)|(?<![\d:])\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?(?![\d:]))"
SOUNDS = r"\[[^\]\[]{0,60}\]|<[^<>]{0,60}>|(?<=^|\s)\([^()]{0,60}\)|\*[^*]{1,60}\*|♪[^♪]{0,60}♪|[♪♫♬♩]+"
HESITATION = r"음+|어+|으+음*|흠+|에+|um+|uh+|erm?|hm+|mm+"
_MARK, _END = "\u001e", "\u001f"

_name = rf"(?:[{SURNAMES}][가-힣]{{1,3}}(?<!니다|시다|세요|아요|어요|네요|지요|까요|데요) |(?:[A-Z][A-Za-z.'-]*,? ){{1,3}})"


def _labels(words: str, number: str, named: bool = False) -> str:
    """Pattern of the ways a label is written, after the segment's begin or a blank; group 1, 2 or 3 holds the number."""
    name = f"(?-i:{_name})?" if named else ""
    word = f"{name}(?:{words}){number}"
    ahead = r"(?<=^|\s)(?:>> ?)?"
    return rf"(?i){ahead}(?:[\[(<] ?{word} ?[\])>](?: ?:)?|{word} ?[:)>](?=\s|$)|{word} - ?(?=\S|$)|{word} -$)"


def _numbered(words: str) -> str:
    n = r"[ _]?0*(\d{1,4})"
    return _labels(words, n)


def _spk(to: str) -> str:
    # whichever way of writing matched, only one of the groups holds the number
    return f"{_MARK}{to}$1$2$3$4{_END}"


def tidied(text: Column) -> Column:
    """The text without clock times and control characters, with single blanks: what labels and their hint are sought in."""
    text = F.regexp_replace(F.regexp_replace(text, f"[{_MARK}{_END}]", ""), CLOCK, " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def marked(text: Column) -> Column:
    """The tidied text with every label replaced by its normalised speaker between two control characters."""
    text = F.regexp_replace(text, _labels(PROFESSOR, r"(?: ?\d{1,2})?", named=True), f"{_MARK}professor{_END}")
    text = F.regexp_replace(text, _labels(ASSISTANT, r"(?: ?\d{1,2})?"), f"{_MARK}assistant{_END}")
    text = F.regexp_replace(text, _numbered(STUDENT), _spk("student"))
    return F.regexp_replace(text, _numbered(VOICE), _spk("speaker"))


def clean_words(chunk: Column) -> Column:
    """The spoken words of a stretch: without clock times, sound annotations and mere hesitation; null if none is left."""
    chunk = F.regexp_replace(chunk, SOUNDS, " ")
    chunk = F.regexp_replace(chunk, rf"(?iU)(?<![\w])(?:{HESITATION})(?![\w])(?:\.{{2,}}|[.,…~]?(?=\s|$))", " ")
    chunk = F.trim(F.regexp_replace(chunk, r"\s+", " "))
    return F.when(chunk.rlike(r"[\p{L}\p{N}]"), chunk)


#: What every label in a tidied text has: one of its words or a number, and the mark that ends a label. Sought before the full patterns.
_HINT = rf"(?i)(?:{PROFESSOR}|{ASSISTANT}|\d) ?(?:[:)>\]]|-)"


def stretches(captions: DataFrame) -> DataFrame:
    """The stretches with speech of all records that carry a label: video_id, off, part, segment_id, start, end, speaker, words."""
    rows = placed_segments(captions, "end").withColumn("text", tidied(form("text")))
    rows = rows.withColumn("hints", F.count_if(F.col("text").rlike(_HINT)).over(Window.partitionBy("video_id"))).where("hints > 0")
    cut = F.split(marked(F.col("text")), _MARK)
    rows = rows.select("video_id", "segment_id", "start", "end", "off", F.posexplode(cut).alias("part", "chunk"))
    label = F.when(F.col("part") > 0, F.substring_index("chunk", _END, 1))
    words = F.when(F.col("part") > 0, F.substring_index("chunk", _END, -1)).otherwise(F.col("chunk"))
    by_video = Window.partitionBy("video_id")
    so_far = by_video.orderBy("off", "part").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("label", label).withColumn("chunk", words)
    rows = rows.withColumn("labels", F.count("label").over(by_video)).where("labels > 0")
    rows = rows.withColumn("speaker", F.coalesce(F.last("label", ignorenulls=True).over(so_far), F.lit("unknown")))
    return rows.withColumn("words", clean_words(F.col("chunk"))).where("words is not null").drop("label", "labels", "chunk")


def turns(captions: DataFrame) -> DataFrame:
    """video_id, turn_no, speaker, segment_id of the first word, start, end and the clean words of every turn.

    Only records with at least one label; speech before the first label is by `unknown`. Null and empty texts and repeated
    rows as in the definition of the record; a null end leaves the turn's end to its other segments.
    """
    w = Window.partitionBy("video_id").orderBy("off", "part")
    rows = stretches(captions)
    new = F.coalesce((F.lag("speaker").over(w) != F.col("speaker")).cast("int"), F.lit(1))
    rows = rows.withColumn("new", new).withColumn("turn_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("off", "part", "segment_id", "start")).alias("first")
    spoken = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("off", "part", "words"))), lambda x: x["words"]), " ")
    by = rows.groupBy("video_id", "turn_no").agg(F.first("speaker").alias("speaker"), first, F.max("end").alias("end"), spoken.alias("words"))
    return by.select("video_id", F.col("turn_no").cast("int").alias("turn_no"), "speaker", "first.segment_id", "first.start", "end", "words")
