"""Normalised metadata from recorded tool payloads: table to table, tools aren't run.

Inputs are tag maps (``payload.tag_map``: entry, tags) and stream documents
(entry, payload: JSON text with "streams" and "format").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as fn
from cairn.functions.payload import as_json_text, canonical_json, tag_chain, tag_native_number, tag_number

# Tags by field, in order of trust.
CAMERA = {
    "camera_make": ["IFD0:Make"],
    "camera_model": ["IFD0:Model", "Canon:CanonModelID"],
    "camera_serial": ["ExifIFD:SerialNumber", "Canon:InternalSerialNumber"],
    "lens_model": ["ExifIFD:LensModel", "Canon:LensModel", "Canon:RFLensType"],
    "lens_serial": ["ExifIFD:LensSerialNumber", "Canon:LensSerialNumber"],
}
PHOTO_TIMES = ["Composite:SubSecDateTimeOriginal", "ExifIFD:DateTimeOriginal", "ExifIFD:CreateDate", "IFD0:ModifyDate"]
VIDEO_TIMES = ["Composite:SubSecDateTimeOriginal", "QuickTime:CreateDate", "Keys:CreationDate", "XMP-xmp:CreateDate"]
OFFSETS = ["ExifIFD:OffsetTimeOriginal", "ExifIFD:OffsetTimeDigitized", "ExifIFD:OffsetTime"]
OTHER_TIMES = ["XMP-exif:DateTimeOriginal", "XMP-xmp:CreateDate"]
FOCAL_35 = ["ExifIFD:FocalLengthIn35mmFormat", "Composite:FocalLength35efl"]
STATUS_ORDER = ["unstable", "timeout", "error", "done", "not_applicable", "skipped"]
STREAMS = "struct<streams:array<struct<index:bigint,codec_type:string,codec_name:string,codec_tag_string:string,profile:string,width:bigint,height:bigint,r_frame_rate:string,avg_frame_rate:string,pix_fmt:string,bits_per_raw_sample:string,color_space:string,bit_rate:string,nb_frames:string,duration:string,sample_rate:string,channels:string,channel_layout:string,tags:map<string,string>>>,format:struct<format_name:string,duration:string,bit_rate:string,nb_streams:string,tags:map<string,string>>>"


def source_of(tags: Column, specs: list[str]) -> Column:
    """The tag that ``tag_chain`` takes its value from."""
    return F.coalesce(*[F.when(tag_chain(tags, [x]).isNotNull(), x) for x in specs])


def capture(tags: Column, times: list[str], others: list[str] = ()) -> dict[str, Column]:
    """Raw time, the tags it and its offset come from, offset and UTC of the capture. An offset is its own tag's, the time's own, or that of another tag with the same wall clock."""
    raw = tag_chain(tags, times)
    own, inside = fn.offset_minutes(tag_chain(tags, OFFSETS)), fn.offset_from_value(raw)
    lent = [fn.matching_offset(raw, F.array(tag_chain(tags, [x]))) for x in others] or [F.lit(None).cast("int")]
    offset = F.coalesce(own, inside, *lent)
    told_by = F.coalesce(F.when(own.isNotNull(), source_of(tags, OFFSETS)), F.when(inside.isNotNull(), "embedded"), *[F.when(c.isNotNull(), x) for c, x in zip(lent, others or [""], strict=True)])
    source = F.concat(source_of(tags, times), F.coalesce(F.concat(F.lit("|offset="), told_by), F.lit("")))
    return {"capture_time_raw": raw, "capture_time_source": source, "capture_tz_offset_min": offset, "capture_time_utc": fn.capture_utc(raw, offset)}


def camera(tags: Column) -> dict[str, Column]:
    found = {name: tag_chain(tags, chain) for name, chain in CAMERA.items()}
    serial = found["lens_serial"]
    return found | {"lens_serial": F.when(~fn.is_all_zero_id(serial), serial)}


def positive(value: Column) -> Column:
    return F.when(value > 0, value)


def photo(rows: DataFrame) -> DataFrame:
    """One row a photo (entry, extension, tags): impossible values are null, see ``validation``."""
    t, dng = F.col("tags"), F.lower(F.col("extension")) == "dng"
    crop = F.when(dng, fn.first_positive_int_pair(tag_chain(t, ["SubIFD:DefaultCropSize"])))
    side = lambda k, name: F.coalesce(crop[k], fn.first_int(F.coalesce(F.when(dng, tag_chain(t, [f"SubIFD:Image{name}"])), tag_chain(t, [f"ExifIFD:ExifImage{name}", f"File:Image{name}"]))))
    focal, focal_35 = tag_number(t, ["ExifIFD:FocalLength"]), tag_number(t, FOCAL_35)
    place = lambda name, shown: F.coalesce(tag_native_number(t, [f"Composite:GPS{name}"]), shown(tag_chain(t, [f"Composite:GPS{name}"])))
    latitude, longitude, altitude = place("Latitude", fn.gps_decimal), place("Longitude", fn.gps_decimal), place("Altitude", fn.first_float)
    nowhere = F.coalesce((latitude == 0) & (longitude == 0), F.lit(False))
    canon = F.coalesce(F.lower(tag_chain(t, CAMERA["camera_make"])).startswith("canon"), F.lit(False))
    balance = F.coalesce(tag_chain(t, ["Canon:WhiteBalance"]), F.when(~canon, tag_chain(t, ["ExifIFD:WhiteBalance"])))
    fields = capture(t, PHOTO_TIMES, OTHER_TIMES) | camera(t) | {
        "width": side(0, "Width"), "height": side(1, "Height"), "orientation": tag_chain(t, ["IFD0:Orientation"]), "iso": fn.first_int(tag_chain(t, ["ExifIFD:ISO"])), "f_number": positive(tag_number(t, ["ExifIFD:FNumber"])),
        "exposure_time": tag_chain(t, ["ExifIFD:ExposureTime"]), "exposure_compensation": tag_native_number(t, ["ExifIFD:ExposureCompensation", "Canon:ExposureCompensation"]), "focal_length_mm": positive(focal), "focal_length_35mm": F.when(focal.isNull() | (focal > 0), positive(focal_35)),
        "white_balance": balance, "color_temperature": tag_native_number(t, ["*:ColorTempAsShot"]).cast("long"), "color_space": tag_chain(t, ["ExifIFD:ColorSpace"]), "icc_profile": tag_chain(t, ["ICC_Profile:ProfileDescription"]), "software": tag_chain(t, ["IFD0:Software", "XMP-xmp:CreatorTool"]),
        "bit_depth": fn.first_int(F.coalesce(F.when(dng, tag_chain(t, ["SubIFD:BitsPerSample"])), tag_chain(t, ["ExifIFD:BitsPerSample", "File:BitsPerSample"]))),
        "gps_latitude": F.when(~nowhere, latitude), "gps_longitude": F.when(~nowhere, longitude), "gps_altitude": F.when(~nowhere, altitude),
    }
    return rows.select("entry", *[c.alias(k) for k, c in fields.items()])


def working(rows: DataFrame) -> DataFrame:
    """One row a layered image (entry, extension, tags)."""
    t = F.col("tags")
    size = lambda name: fn.first_int(tag_chain(t, [f"ExifIFD:ExifImage{name}", f"File:Image{name}"]))
    return rows.select(
        "entry", F.col("extension").alias("file_variant"), tag_chain(t, ["IFD0:Software", "XMP-xmp:CreatorTool"]).alias("creator_app"), tag_chain(t, ["Photoshop:ColorMode", "XMP-photoshop:ColorMode"]).alias("color_mode"), fn.first_int(tag_chain(t, ["Photoshop:BitDepth"])).alias("bit_depth"),
        size("Width").alias("width"), size("Height").alias("height"), fn.first_int(tag_chain(t, ["Photoshop:LayerCount"])).alias("layer_count"), as_json_text(tag_chain(t, ["Photoshop:LayerUnicodeNames", "Photoshop:LayerNames"])).alias("layer_names"), F.try_element_at(t, F.lit("photoshop:photoshopthumbnail")).isNotNull().cast("int").alias("has_thumbnail"),
    )


def document(rows: DataFrame) -> DataFrame:
    """One row an office document (entry, extension, tags)."""
    t = F.col("tags")
    any_ = lambda *names: tag_chain(t, [f"*:{n}" for n in names])
    return rows.select(
        "entry", F.col("extension").alias("doc_format"), any_("Title").alias("title"), any_("Author", "Creator").alias("author"), any_("LastModifiedBy").alias("last_modified_by"), any_("Application", "Producer", "Software").alias("creator_app"), any_("CreateDate", "CreationDate").alias("created_prop_raw"),
        any_("ModifyDate", "ModDate").alias("modified_prop_raw"), fn.first_int(any_("Pages", "PageCount")).alias("page_count"), F.try_element_at(t, F.lit("*:encryption")).isNotNull().cast("int").alias("is_encrypted"),
    )


def parsed_streams(payloads: DataFrame) -> DataFrame:
    return payloads.select("entry", F.from_json("payload", STREAMS).alias("p"))


def streams(payloads: DataFrame, kind: str) -> DataFrame:
    """A row for every video or audio stream."""
    s = parsed_streams(payloads).select("entry", F.explode("p.streams").alias("s")).where(F.col("s.codec_type") == kind)
    common = ["entry", F.col("s.index").alias("stream_index"), "s.codec_name", "s.profile", fn.first_int(F.col("s.bit_rate")).alias("bit_rate"), fn.first_float(F.col("s.duration")).alias("duration_seconds")]
    if kind == "video":
        return s.select(*common, F.col("s.codec_tag_string").alias("codec_tag"), "s.width", "s.height", "s.r_frame_rate", "s.avg_frame_rate", "s.pix_fmt", fn.first_int(F.col("s.bits_per_raw_sample")).alias("bit_depth"), "s.color_space", fn.first_int(F.col("s.nb_frames")).alias("nb_frames"))
    return s.select(*common, fn.first_int(F.col("s.sample_rate")).alias("sample_rate"), fn.first_int(F.col("s.channels")).alias("channels"), "s.channel_layout")


def audio_fallback(found: DataFrame, tagged: DataFrame) -> DataFrame:
    """``found`` audio streams, and one from the tags of every audio entry without any."""
    t = F.col("tags")
    rate = fn.first_int(tag_chain(t, ["AAC:SampleRate"]))
    file_type = F.lower(tag_chain(t, ["File:FileType"]))
    is_audio = rate.isNotNull() | F.lower(tag_chain(t, ["File:MIMEType"])).startswith("audio/") | (file_type == "aac")
    extra = tagged.join(found, "entry", "left_anti").where(is_audio).select(
        "entry", F.lit(0).cast("long").alias("stream_index"), F.coalesce(file_type, F.lit("aac")).alias("codec_name"), fn.first_float(tag_chain(t, ["*:Duration"])).alias("duration_seconds"), rate.alias("sample_rate"), positive(fn.first_int(tag_chain(t, ["AAC:Channels"]))).alias("channels"),
    )
    return found.unionByName(extra, allowMissingColumns=True)


def audio_video(tagged: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row a film or recording from both providers; the container's own tags come before those of the tag tool."""
    both = tagged.select("entry", "tags").join(parsed_streams(payloads), "entry", "full_outer")
    t, p = F.coalesce("tags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<value:string,number:string>>"))), F.col("p")
    own = F.transform_keys(F.coalesce(p["format"]["tags"], F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    of_video = F.filter(p["streams"], lambda s: s["codec_type"] == "video")
    tag = lambda name: F.coalesce(F.nullif(F.try_element_at(own, F.lit(name)), F.lit("")), F.try_element_at(F.array_compact(F.transform(of_video, lambda s: F.try_element_at(s["tags"], F.lit(name)))), F.lit(1)))
    mine = lambda *names: F.coalesce(*[F.nullif(F.try_element_at(own, F.lit(n)), F.lit("")) for n in names])
    any_ = lambda *names: tag_chain(t, [f"*:{n}" for n in names])
    seen, cam = capture(t, VIDEO_TIMES), camera(t)
    made = fn.normalize_explicit_utc(mine("creation_time"))
    fresh = seen["capture_time_raw"].isNull() & made.isNotNull()
    drone = fn.drone_model(tag_chain(t, ["Microsoft:Category"]))
    is_drone = drone.isNotNull() | F.exists(F.map_keys(t), lambda k: k.rlike("^[^*:]*dji"))
    return both.select(
        "entry", F.coalesce(p["format"]["format_name"], F.lower(tag_chain(t, ["File:FileType"]))).alias("container_format"), F.coalesce(F.nullif(fn.first_float(p["format"]["duration"]), F.lit(0.0)), fn.first_float(any_("Duration"))).alias("duration_seconds"),
        fn.first_int(p["format"]["bit_rate"]).alias("bit_rate"), fn.first_int(p["format"]["nb_streams"]).alias("stream_count"), tag("timecode").alias("timecode"), F.coalesce(tag("encoder"), tag_chain(t, ["ItemList:Encoder"])).alias("encoder"),
        F.when(fresh, mine("creation_time")).otherwise(seen["capture_time_raw"]).alias("capture_time_raw"), F.when(fresh, "format:creation_time").otherwise(seen["capture_time_source"]).alias("capture_time_source"), F.when(fresh, 0).otherwise(seen["capture_tz_offset_min"]).alias("capture_tz_offset_min"), F.coalesce(seen["capture_time_utc"], made).alias("capture_time_utc"),
        F.coalesce(cam["camera_make"], F.when(is_drone, "DJI")).alias("camera_make"), F.coalesce(cam["camera_model"], drone).alias("camera_model"), cam["camera_serial"].alias("camera_serial"), cam["lens_model"].alias("lens_model"), cam["lens_serial"].alias("lens_serial"),
        F.coalesce(mine("title"), any_("Title")).alias("title"), F.coalesce(mine("artist", "author"), any_("Artist", "Author", "Creator", "AlbumArtist", "Composer")).alias("author"), F.coalesce(mine("album"), any_("Album")).alias("album"), F.coalesce(mine("copyright"), any_("Copyright", "CopyrightNotice")).alias("copyright"),
    )


def gps_points(payloads: DataFrame) -> DataFrame:
    """entry, point_index and place of every location tag, wherever it stands (a text or a list of texts)."""
    p = parsed_streams(payloads)
    maps = F.concat(F.array(F.col("p.format.tags")), F.coalesce(F.transform("p.streams", lambda s: s["tags"]), F.array().cast("array<map<string,string>>")))
    pairs = F.flatten(F.transform(F.array_compact(maps), lambda m: F.map_entries(F.map_filter(m, lambda k, v: F.lower(k) == "location"))))
    values = F.flatten(F.transform(pairs, lambda e: F.coalesce(F.from_json(e["value"], "array<string>"), F.array(e["value"]))))
    each = p.select("entry", F.posexplode(values).alias("at", "raw_value")).withColumn("g", fn.iso6709(F.col("raw_value"))).where("g is not null")
    found = each.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("at", "raw_value", "g"))).alias("points"))
    return found.select("entry", F.posexplode("points").alias("point_index", "x")).select("entry", "point_index", F.col("x.g.latitude").alias("gps_latitude"), F.col("x.g.longitude").alias("gps_longitude"), F.col("x.g.altitude").alias("gps_altitude"), "x.raw_value")


def reported(payloads: DataFrame) -> DataFrame:
    """A diagnostic for every Warning and Error tag, whatever family. payloads: entry, payload."""
    key = F.lower(F.element_at(F.split("k", ":"), -1))
    each = payloads.select("entry", F.explode(F.from_json("payload", "map<string,variant>")).alias("k", "v")).withColumn("severity", key).where("severity in ('warning', 'error')")
    shown = F.coalesce(F.try_variant_get("v", "$.val", "variant"), F.col("v"))
    texts = F.coalesce(F.from_json(F.to_json(shown), "array<string>"), F.array(F.coalesce(F.try_variant_get(shown, "$", "string"), F.to_json(shown))))
    return each.select("entry", "severity", F.concat(F.lit("exiftool_reported_"), F.col("severity")).alias("diagnostic_code"), F.col("k").alias("field_name"), F.explode(texts).alias("message"))


#: What the diagnostics of impossible values say.
MESSAGES = {
    "invalid_all_zero_lens_serial": "a lens serial of zeros alone counts as none",
    "invalid_nonpositive_f_number": "an f-number that isn't above 0 counts as none",
    "invalid_nonpositive_focal_length": "a focal length that isn't above 0 counts as none, and so does its 35 mm equivalent",
    "invalid_nonpositive_focal_length_35mm": "a 35 mm equivalent that isn't above 0 counts as none",
    "invalid_zero_gps_placeholder": "latitude and longitude of 0 are a placeholder and count as no place",
}


def validation(rows: DataFrame) -> DataFrame:
    """A diagnostic for every impossible value of a photo's tags (entry, tags)."""
    t = F.col("tags")
    number = lambda *specs: tag_number(t, list(specs))
    zero = (F.coalesce(tag_native_number(t, ["Composite:GPSLatitude"]), fn.gps_decimal(tag_chain(t, ["Composite:GPSLatitude"]))) == 0) & (F.coalesce(tag_native_number(t, ["Composite:GPSLongitude"]), fn.gps_decimal(tag_chain(t, ["Composite:GPSLongitude"]))) == 0)
    focal = number("ExifIFD:FocalLength")
    raw = lambda spec: F.try_element_at(t, F.lit(spec.lower()))["value"]
    places = F.to_json(F.struct(*[raw(f"Composite:GPS{n}").alias(n.lower()) for n in ("Latitude", "Longitude", "Altitude")]), {"ignoreNullFields": "false"})
    rules = {
        "invalid_all_zero_lens_serial": (fn.is_all_zero_id(tag_chain(t, CAMERA["lens_serial"])), "lens_serial", tag_chain(t, CAMERA["lens_serial"])), "invalid_nonpositive_f_number": (number("ExifIFD:FNumber") <= 0, "f_number", raw("ExifIFD:FNumber")),
        "invalid_nonpositive_focal_length": (focal <= 0, "focal_length_mm", raw("ExifIFD:FocalLength")), "invalid_nonpositive_focal_length_35mm": ((focal.isNull() | (focal > 0)) & (number(*FOCAL_35) <= 0), "focal_length_35mm", tag_chain(t, FOCAL_35)), "invalid_zero_gps_placeholder": (zero, "gps_latitude", places),
    }
    hits = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(code).alias("diagnostic_code"), F.lit(field).alias("field_name"), F.lit(MESSAGES[code]).alias("message"), value.alias("raw_value"))) for code, (cond, field, value) in rules.items()]))
    return rows.select("entry", F.explode(hits).alias("d")).select("entry", F.lit("validation").alias("severity"), "d.*")


def av_validation(entries: DataFrame, payloads: DataFrame) -> DataFrame:
    """Errors of media without streams, audio without audio, and audio that is a header only. entries: entry, media_kind, size."""
    both = entries.join(parsed_streams(payloads), "entry")
    sound = F.filter("p.streams", lambda s: s["codec_type"] == "audio")
    lasting = (fn.first_float(F.col("p.format.duration")) > 0) | F.exists(sound, lambda s: F.coalesce(fn.first_float(s["duration"]) > 0, F.lit(False)))
    is_audio = F.col("media_kind") == "audio"
    code = F.when(F.coalesce(F.size("p.streams"), F.lit(0)) < 1, "media_no_streams").when(is_audio & (F.size(sound) < 1), "audio_stream_missing").when(is_audio & (F.col("size") <= 44) & ~F.coalesce(lasting, F.lit(False)), "audio_no_samples")
    return both.select("entry", F.lit("error").alias("severity"), code.alias("diagnostic_code")).where("diagnostic_code is not null")


def route(kind: Column) -> Column:
    """Which normaliser takes a media kind."""
    return F.when(kind.isin("photo_raw", "photo_jpeg"), "photo").when(kind.isin("photo_working", "image_gif"), "working").when(kind.isin("video_mp4", "video_crm", "audio"), "audio_video").when(kind == "document", "document").when(kind == "archive", "archive").otherwise("none")


def meta_status(outcomes: DataFrame) -> DataFrame:
    """entry and the outcome that counts, of several by provider; skipped if there is none."""
    rank = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("outcome"))
    return outcomes.groupBy("entry").agg(F.coalesce(F.min_by("outcome", F.when(rank > 0, rank)), F.lit("skipped")).alias("meta_status"))


def diagnostic_errors(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics of severity error as rows of the error table."""
    return diagnostics.where("severity = 'error'").select("entry", F.lit("metadata").alias("stage"), F.col("diagnostic_code").alias("error_code"), "message")


def build_payload(raw: DataFrame) -> DataFrame:
    """entry, provider, canonical payload, its digest and size."""
    text = canonical_json(F.col("payload"))
    return raw.select("entry", "provider", text.alias("payload"), F.sha2(text.cast("binary"), 256).alias("payload_sha256"), F.octet_length(text).alias("uncompressed_bytes"))


def normalized(entries: DataFrame, tagged: DataFrame, streams_of: DataFrame) -> dict[str, DataFrame]:
    """The job that routes every entry to its normaliser: photo, working, document and audio_video rows, and meta_status (skipped where no normaliser gave anything).

    entries: entry, extension, media_kind; tagged: entry, tags; streams_of: entry, payload.
    """
    routed = entries.withColumn("_to", route(F.col("media_kind")))
    of = lambda name: routed.where(F.col("_to") == name).join(tagged, "entry").select("entry", "extension", "tags")
    wanted = routed.where("_to = 'audio_video'").select("entry")
    made = {"photo": photo(of("photo")), "working": working(of("working")), "document": document(of("document"))}
    made["audio_video"] = audio_video(tagged.join(wanted, "entry", "left_semi"), streams_of.join(wanted, "entry", "left_semi"))
    done = None
    for df in made.values():
        part = df.select("entry").distinct()
        done = part if done is None else done.unionByName(part)
    outcomes = routed.select("entry").join(done.withColumn("_done", F.lit(True)), "entry", "left").select("entry", F.when(F.col("_done"), "done").alias("outcome"))
    return made | {"meta_status": meta_status(outcomes)}
