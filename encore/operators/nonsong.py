"""Rows of a timestamp list that are no songs: ordered rules over title, artist and raw line.

All rules become one CASE expression, whose first rule that holds gives the reason. What is
known of the artist matters: many words are a title where one is named, and a remark where none is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.functions import parsing
from encore.functions import text as tx

# Names of an unknown artist.
UNKNOWN = r"(?i)^(?:|未記載|未记载|unknown|n/a|na|none|null|不明|なし|无|待补歌手|待補歌手|待补|待補|-)$"
# Reason, fields that are read, whether the artist must be unknown (no: None, or
# known: False), and pattern. Fields: T title, A artist, R title and raw line, B title and artist.
RULES: tuple[tuple[str, str, bool | None, str], ...] = (
    ("emoji_only", "T", None, r"^(?:\s*:_?[A-Za-z0-9_]+:\s*)+$"),
    ("song_total", "T", None, r"^全\s*[0-9]{1,3}\s*曲$"),
    ("weekday_schedule", "T", None, r"[（(]\s*[月火水木金土日]\s*[）)]"),
    ("next_schedule", "T", None, r"^(?:次回は?|次は|余談ですが|お知らせ)\s*[0-9]{1,2}$"),
    ("date_as_artist", "A", None, r"^(?:(?:19|20)[0-9]{2}\s*[年/])?[0-9]{1,2}\s*[月/]\s*[0-9]{1,2}\s*日?$"),
    ("clock_marker", "T", None, r"(?i)^(?:開場|開演|開始|START|スタート|配信)?\s*[:：┊|]?\s*[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s*(?:開場|開演|開始|まで|START)?\s*[!！~〜～]*\s*$"),
    ("clock_marker", "T", None, r"(?i)^[■□●○◇◆・･\-–—>≫*＊\s]*[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s*[~〜～\-–—]*\s*(?:開場|開演|開始|まで|スタート|start)?\s*$"),
    ("date_alone", "T", True, r"^(?:(?:19|20)[0-9]{2}\s*[年/.-])?[0-9]{1,2}\s*[月/.-]\s*[0-9]{1,2}\s*日?$"),
    ("timetable", "B", None, r"[0-9]{1,2}:[0-5][0-9](?::[0-5][0-9])?\s*(?:開場|開演|開始)"),
    ("deadline", "T", None, r"[【\[（(][^】\]）)]{0,80}[0-9]{1,2}:[0-5][0-9]\s*まで"),
    ("date_range", "T", None, r"^(?:(?:19|20)[0-9]{2}\s*[年/])?[0-9]{1,2}\s*[月/]\s*[0-9]{1,2}\s*日?\s*[~〜～\-–—]+\s*[0-9]{1,2}\s*日?$"),
    ("seating", "T", None, r"(?:現地|会場|入場|[0-9]{1,2}\s*[月/]\s*[0-9]{1,2}).*(?:着席|スタンディング|立見)|(?:着席|スタンディング|立見).*(?:現地|会場|入場|[0-9]{1,2}\s*[月/]\s*[0-9]{1,2})"),
    ("deadline", "A", None, r"[0-9]{1,2}:[0-5][0-9]\s*まで"),
    ("weekday_as_artist", "A", None, r"^(?:平日|土日|祝日?)$"),
    ("standby", "T", None, r"^[~〜～\s]*(?:待機|待機映像|待機中|待機画面|待機モーション)(?:[~〜～].{0,20})?$"),
    ("sale", "T", None, r"^[~〜～\-–—]*(?:恒常)?販売(?:中)?$"),
    ("sale", "T", None, r"^まで\s*(?:販売|購入・視聴可能です[!！]?)$"),
    ("sale", "T", None, r"^.{0,20}発売中$"),
    ("watch_along", "T", None, r"^[~〜～\s]*(?:アニメーション)?同時視聴中?$"),
    ("ceremony", "T", None, r"^[┊|｜■□●○\s]*(?:閉|開)会式(?:\s*[@＠].*)?$"),
    ("sale_period", "T", None, r"^[【\[]?(?:販売期間|受注期間|受付期間|予約期間)[】\]]?\s*[:：]?\s*(?:[0-9]|$)"),
    ("sale_period", "T", None, r"^[【\[]?(?:販売期間|受注期間|受付期間|予約期間)[】\]]?.{0,12}?[0-9]{1,2}\s*月"),
    ("live_camera", "T", None, r"ライブカメラ.*[0-9]{4}\s*[/.-]\s*[0-9]{1,2}|[0-9]{4}\s*[/.-]\s*[0-9]{1,2}.*ライブカメラ"),
    ("numeric_fragment", "T", None, r"^0[0-9]+[.．][0-9]+(?:\s*[/／].*)?$"),
    ("party", "T", True, r"^(?:[0-9]+次会|達成[!！]?|歌みたの話)$"),
    ("start", "T", True, r"(?i)^(?:(?:歌|配信)?枠)?\s*(?:start|stream\s*start|karaoke\s*start|開始)$"),
    ("marker", "T", None, r"(?i)^(?:音入り|音入[り]?|声入り|マイクテスト|開始|終了|结束|結束|曲始まり|オープニング|エンディング|登場|退場|ゲスト|スパチャ読み|読み開始|コメント読み|告知|雑談|雑談タイム[!！]?|休憩|休憩[&＆]?雑談タイム|新しいOP画面|OP画面|OPトーク|待機OPstart|EDトーク|カンニングタイム(?:Part[0-9]+)?|ただいま|まで)$"),
    ("talk", "T", None, r"^雑談\s*[/／|｜]\s*\S"),
    ("talk", "T", None, r"^トークパート[①-⑳0-9]*$"),
    ("talk", "A", None, r"^トークパート[①-⑳0-9]*$"),
    ("introduction", "T", True, r"^自己紹介(?:込み)?$"),
    ("tuning", "T", None, r"^(?:曲入り前の解説|チューニング入ります)$"),
    ("stream_event", "R", None, r"(?i)(?:曲始まり|オープニング|エンディング|登場|退場|スパチャ読み|コメント読み|チャット読み|ギフト(?:は)?読|読み開始|読み上げ|告知|宣伝|配信終了|配信開始|販売開始|オンライン販売|高評価|ch登録|チャンネル登録|登録者(?:数)?|視聴者|OBS|お手洗い休憩|チャットお題|[0-9]+\s*達成|開始\s*[/／]|虚空|ゲスト匂わせ|スパチャ|メモは紙|ライブでやる曲|明日の曲について)"),
    ("photo_or_live", "R", None, r"(?:手で表現した|お写真公開|写真公開|ライブ開催決定|お披露目で.+やりたい|スタンドマイク回したかった)"),
    ("part_of_show", "T", True, r"^(?:本編開始|全曲終了|全曲结束|全曲結束|開始[・\s]?|終了[・\s]?|结束[・\s]?|結束[・\s]?|特別ゲスト|突然の)"),
    ("remark", "R", True, r"(?:お話|話$|話①|話②|話題|裏話|スケジュール|おすすめ|コメント|チャット|ギフト|設定|手癖|腰|良い音|到着|ただいま|お土産|先生|予想|コンディション|休暇中|気圧|体調|配信|動画|映画|クリップ|バランス|読み|頑張|ありがとう|お疲れ|おつかれ)"),
    ("explanation", "R", True, r"(?:説明|自己紹介|お知らせ|公開|正体|マイク|音声|音入り|声入り|曲名|歌手|アーティスト|リクエスト|セトリ|セットリスト|概要欄|説明欄)"),
    ("greeting", "T", True, r"^(?:おはよう|おはようございます|こんにちは|こんばんは)[^\n]{0,28}(?:です|だよ|でーす)[!！。.\s]*$"),
    ("greeting", "T", True, r"^(?:おはよう|おはようございます|こんにちは|こんばんは)[ー〜～?？!！。.\s]*$"),
    ("exclamation", "T", True, r"^.{0,4}(?:実は|ほら|悲報|どうすか|めっちゃいい|新しいこと|魅惑の腰|別の意味で|フラグ立て|まさか今|ここから|いつもより|苦しうない).{0,8}$"),
    ("activity_as_artist", "A", False, r"^(?:咳払い|くしゃみ|雑談|告知|宣伝|休憩)$"),
)
# What a raw line says of sales and broadcasts, times in it, and numbers of chapters.
PROMOTION = r"(?i)(?:NEWS\s*速報|次回配信|記念配信|朝活配信|(?:発売|販売|受注|予約)中(?:です)?|(?:販売|受注|予約|受付)期間)"
TIME_CONTEXT = r"(?:[0-9]{1,2}\s*[/月]\s*[0-9]{1,2}|[0-9]{1,2}\s*日|[0-9]{1,2}\s*(?::|時)\s*[0-9]{0,2}|まで)"
NUMBER = r"(?:第\s*)?(?:[0-9]{1,3}|[一二三四五六七八九十百千万零〇两]{1,4})(?:\s*(?:位|番|曲目|曲|章|回))?"
TIMESTAMP = r"^.*?(?<![0-9:])(?:[0-9]{1,2}:)?[0-9]{1,2}:[0-5][0-9](?![0-9:])\s*"


def normal(x: Column) -> Column:
    return F.trim(tx.half_width(F.coalesce(x, F.lit(""))))


def entry_reason(title: Column, artist: Column, both: Column, pair: Column, unknown: Column) -> Column:
    """The reason why a row is no song, or null. Fields are normal; both and pair are as in ``RULES``."""
    fields, needs = {"T": title, "A": artist, "R": both, "B": pair}, {True: unknown, False: ~unknown}
    holds = lambda field, need, pattern: fields[field].rlike(pattern) if need is None else needs[need] & fields[field].rlike(pattern)
    return reduce(lambda case, rule: case.when(holds(*rule[1:]), rule[0]), RULES, F)


def with_reasons(rows: DataFrame) -> DataFrame:
    """``rows`` of (title, artist, raw, ..) with ``entry`` and ``line``, why each is no song, or null.

    Promotions with a time and numbers of chapters are noise as they stand. Other lines are
    parsed again, as the fields may have lost what the line still has; only if that finds no
    song, too, is the line noise. Fields that several rules read are columns of their own step.
    """
    c = F.col
    kept = rows.columns
    x = rows.withColumns({"_title": normal(c("title")), "_artist": normal(c("artist")), "_raw": normal(c("raw"))})
    x = x.withColumns({"_tail": F.trim(F.regexp_replace("_raw", TIMESTAMP, "")), "_unknown": c("_artist").rlike(UNKNOWN), "_both": F.concat_ws(" ", "_title", "_raw"), "_pair": F.concat_ws(" ", "_title", "_artist")})
    x = x.withColumn("_song", tx.without_list_marker(c("_tail")))
    x = x.withColumns({"_title2": parsing.title_of(c("_song")), "_artist2": parsing.artist_of(c("_song"))})
    x = x.withColumns({"_both2": F.concat_ws(" ", "_title2", "_song"), "_pair2": F.concat_ws(" ", "_title2", "_artist2"), "_unknown2": c("_artist2").rlike(UNKNOWN)})
    x = x.withColumn("entry", entry_reason(*map(c, ("_title", "_artist", "_both", "_pair", "_unknown"))))
    x = x.withColumn("_again", F.when(c("_song") == "", "empty").otherwise(entry_reason(*map(c, ("_title2", "_artist2", "_both2", "_pair2", "_unknown2")))))
    timed = c("_unknown") & c("_raw").rlike(TIMESTAMP)
    either = lambda p: c("_tail").rlike(p) | c("_title").rlike(p)
    line = (
        F.when(c("_raw") == "", None)
        .when(c("_unknown") & c("_raw").rlike(PROMOTION) & c("_raw").rlike(TIME_CONTEXT), "explicit_schedule_or_promotion")
        .when(timed & either(rf"^[【\[［(（「『]\s*{NUMBER}\s*[】\]］)）」』]$"), "bracketed_numeric_marker")
        .when(timed & either(rf"^{NUMBER}[、.．:：-]?$"), "bare_numeric_chapter_marker")
        .when(c("_again").isNotNull(), F.concat(F.lit("raw_"), c("_again")))
    )
    return x.select(*kept, "entry", line.alias("line"))
