"""What a message is: forwarded bundle, video, image or text, with its content, fingerprints and whether it gets an embedding.

Messages come with group_id, text, ``components`` array<struct<type, id, path, url, file, readable>> and ``raw`` array<struct<type, data
map<string, string>>> (the platform's own segments); image descriptions come as ``described`` map<source, description> (from a
provider; stickers have none), bundles as columns of operators.forwards.EXPANDED, null where there are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.functions import urls
from echotrace.functions.names import LONGEST_NAME, declared_size, file_name, local_path
from echotrace.functions.text import strip
from echotrace.operators.forwards import EXPANDED

# fixed values: how many videos of a message count, and how contents name media
MOST_VIDEOS = 3
VIDEO_LABEL, IMAGE_LABEL, NAMES_BETWEEN = "[视频]", "[图片内容: ", "、"


def _some(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def video_components(components: Column, raw: Column) -> Column:
    """The first videos of a message, in order, joined by place with the platform's segments: array of name, declared_size, source, source_method,
    source_conflict, file_reference.  A readable file of the message comes first, then addresses, then files."""
    videos = F.slice(F.filter(components, lambda c: F.lower(c["type"]) == "video"), 1, MOST_VIDEOS)
    segments = F.transform(F.filter(raw, lambda s: (F.lower(s["type"]) == "video") & s["data"].isNotNull()), lambda s: s["data"])

    def made(c: Column, k: Column) -> Column:
        data = F.coalesce(F.try_element_at(segments, k + 1), F.create_map().cast("map<string,string>"))
        of = lambda name: _some(data[name])
        path = F.when(F.coalesce(c["readable"], F.lit(False)) & local_path(c["path"]).isNotNull(), c["path"])
        ways = [(path, "component_path"), (of("url"), "raw_url"), (_some(c["url"]), "component_url"), (_some(c["file"]), "component_file")]
        method, source = F.lit("raw_file"), F.coalesce(of("file"), F.lit(""))
        for value, name in reversed(ways):
            method, source = F.when(value.isNotNull(), name).otherwise(method), F.coalesce(value, source)
        named = F.coalesce(F.nullif(data["file"], F.lit("")), F.nullif(data["file_name"], F.lit("")), F.nullif(data["name"], F.lit("")), source)
        return F.struct(
            file_name(named).alias("name"), declared_size(data["file_size"], data["size"]).alias("declared_size"), source.alias("source"), method.alias("source_method"),
            F.coalesce(of("url") != _some(c["url"]), F.lit(False)).alias("source_conflict"), F.coalesce(of("file"), _some(c["file"]), F.lit("")).alias("file_reference"),
        )

    return F.coalesce(F.transform(videos, made), F.transform(F.array().cast("array<string>"), lambda _: made(F.lit(None).cast("struct<type:string,id:string,path:string,url:string,file:string,readable:boolean>"), F.lit(0))))


def _once(rows: DataFrame, made: dict[str, Column]) -> DataFrame:
    """With new or replaced columns, as rows of an inlined array of one: filters on them stay above, instead of repeating what they are made of."""
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in made], F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def image_sources(components: Column) -> Column:
    source = lambda c: F.coalesce(F.nullif(c["path"], F.lit("")), F.nullif(c["url"], F.lit("")), F.nullif(c["file"], F.lit("")))
    found = F.transform(F.filter(components, lambda c: F.lower(c["type"]) == "image"), source)
    return F.coalesce(F.array_compact(found), F.array().cast("array<string>"))


def forward_id(components: Column) -> Column:
    """The id of the first forwarded bundle: empty if it has none, null if there is no bundle."""
    first = F.try_element_at(F.filter(components, lambda c: F.lower(c["type"]) == "forward"), F.lit(1))
    return F.when(first.isNotNull(), F.coalesce(strip(first["id"]), F.lit("")))


def video_content(text: Column, videos: Column) -> Column:
    names = F.array_join(F.filter(F.transform(videos, lambda v: v["name"]), lambda n: n != ""), NAMES_BETWEEN)
    return strip(F.concat(text, F.lit(f" {VIDEO_LABEL}"), F.when(names != "", F.concat(F.lit(" "), names)).otherwise("")))


def image_content(text: Column, description: Column) -> Column:
    return F.concat(F.when(text != "", F.concat(text, F.lit(" "))).otherwise(""), F.lit(IMAGE_LABEL), description, F.lit("]"))


def route(messages: DataFrame, *, videos_on: bool = True, urls_on: bool = True, tracking: tuple[str, ...] = urls.TRACKING) -> DataFrame:
    """``messages`` with modality (forward, video, image, text; null: nothing to keep), content and what belongs to it.

    A bundle goes before videos, these before the first image with a description, that before text.  A bundle with no id or one too
    long leaves its text alone; images that are all stickers leave the text, without a fingerprint of its URL."""
    text = F.coalesce(strip(F.col("text")), F.lit(""))
    bundle, images = forward_id(F.col("components")), image_sources(F.col("components"))
    rows = _once(messages, {"_text": text, "_forward": bundle, "_images": images, "_videos": video_components(F.col("components"), F.col("raw"))})
    text, images, videos = F.col("_text"), F.col("_images"), F.col("_videos")
    kept = (F.col("_forward") != "") & (F.length("_forward") <= LONGEST_NAME)
    shown = F.try_element_at(F.filter(images, lambda s: F.col("described")[s].isNotNull()), F.lit(1))
    only_text = F.when(text != "", "text")
    kind = F.when(F.col("_forward").isNotNull(), F.when(kept, "forward").otherwise(only_text))
    kind = kind.when(F.lit(videos_on) & (F.size(videos) > 0), "video").when(shown.isNotNull(), "image").otherwise(only_text)
    rows = _once(rows, {"modality": kind, "_shown": shown})
    is_ = lambda m: F.coalesce(F.col("modality") == m, F.lit(False))
    rows = rows.withColumn("_url", urls.normalised(F.when(is_("text") & F.col("_forward").isNull() & (F.size(images) == 0) & F.lit(urls_on), text), tracking))
    described = F.col("described")[F.col("_shown")]
    content = F.when(is_("forward"), F.concat_ws("\n", F.nullif(text, F.lit("")), F.coalesce("forward_content", F.lit("")))).when(is_("video"), video_content(text, videos)).when(is_("image"), image_content(text, described)).when(is_("text"), text)
    rows = _once(
        rows,
        {
            "content": content, "video_text": F.when(is_("video"), text), "videos": F.when(is_("video"), videos), "image_source": F.when(is_("image"), F.col("_shown")), "image_description": F.when(is_("image"), described),
            "forward_id": F.when(is_("forward"), F.col("_forward")), "url_only": F.col("_url").isNotNull(), "url_hash": urls.fingerprint(F.col("_url")), "url_host": F.when(F.col("_url").isNotNull(), urls.url_host(F.col("_url"))),
            "has_image": is_("image") | (is_("forward") & F.coalesce("has_image", F.lit(False))), "has_video": is_("video") | (is_("forward") & F.coalesce("has_video", F.lit(False))),
            **{c: F.when(is_("forward"), F.col(c)) for c in FORWARD_COLUMNS},
        },
    )
    return rows.drop("_text", "_forward", "_images", "_videos", "_shown", "_url")


#: what a bundle brings along besides whether it has images and videos
FORWARD_COLUMNS = [c.split()[0] for c in EXPANDED.split(", ") if not c.startswith("has_")]


def embedding_content(routed: DataFrame) -> Column:
    """What of a routed message is to be embedded, null if nothing: not URLs, bundles, or videos that are matched by their fingerprints;
    of other videos the user's own text, without the names that the content holds."""
    text = F.when(F.col("has_video"), F.nullif(strip(F.coalesce("video_text", F.lit(""))), F.lit(""))).otherwise(F.col("content"))
    usable = F.col("usable_video") if "usable_video" in routed.columns else F.lit(False)
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = no("url_only") | F.col("forward_id").isNotNull() | no("forward_truncated") | no("forward_partial") | F.coalesce(usable, F.lit(False))
    return F.when(~out & F.col("modality").isNotNull(), text)
