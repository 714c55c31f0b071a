"""Scalar functions of disc data, Column to Column, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: codes of the disc formats and the names that results carry
CODECS = {2: "MPEG-2", 27: "H.264", 32: "H.264", 36: "HEVC", 128: "LPCM", 129: "AC-3", 130: "DTS", 131: "TrueHD", 132: "EAC-3", 133: "DTS-HD HR", 134: "DTS-HD MA", 144: "PGS", 161: "EAC-3", 162: "DTS-HD MA", 234: "VC-1"}
CODEC_KINDS = {"HEVC": "video", "H.264": "video", "VC-1": "video", "MPEG-2": "video", "TrueHD": "audio", "DTS-HD MA": "audio", "DTS-HD HR": "audio", "DTS": "audio", "AC-3": "audio", "EAC-3": "audio", "LPCM": "audio", "PGS": "subtitle"}
RESOLUTIONS = {1: "480i", 2: "576i", 3: "480p", 4: "1080i", 5: "720p", 6: "1080p", 7: "576p", 8: "2160p"}
PIXELS = {"480i": (720, 480), "480p": (720, 480), "576i": (720, 576), "576p": (720, 576), "720p": (1280, 720), "1080i": (1920, 1080), "1080p": (1920, 1080), "2160p": (3840, 2160), "4320p": (7680, 4320)}
FRAME_RATES = {1: ("23.976", 24000, 1001), 2: ("24", 24, 1), 3: ("25", 25, 1), 4: ("29.97", 30000, 1001), 5: ("30", 30, 1), 6: ("50", 50, 1), 7: ("59.94", 60000, 1001), 8: ("60", 60, 1)}
CHANNELS = {1: ("mono", 1), 3: ("stereo", 2), 6: ("5.1", 6), 12: ("7.1", 8)}
SAMPLE_RATES = {1: 48000, 4: 96000, 5: 192000, 12: 48000, 14: 48000}
COMPOUND_LANGUAGES = (
    ("brazilian portuguese", "por", "Brazilian"), ("euro portuguese", "por", "European"), ("european portuguese", "por", "European"),
    ("castilian spanish", "spa", "Castilian"), ("latin american spanish", "spa", "Latin American"), ("latin spanish", "spa", "Latin American"),
    ("canadian french", "fra", "Canadian"), ("parisian french", "fra", "Parisian"), ("australian english", "eng", "Australian"),
    ("austrailian english", "eng", "Australian"), ("british english", "eng", "British"), ("simplified chinese", "zho", "Simplified"),
    ("traditional chinese", "zho", "Traditional"), ("mandarin chinese", "zho", "Mandarin"), ("cantonese chinese", "zho", "Cantonese"),
)
LANGUAGES = (
    ("english", "eng"), ("spanish", "spa"), ("french", "fra"), ("german", "deu"), ("italian", "ita"), ("japanese", "jpn"), ("chinese", "zho"),
    ("mandarin", "zho"), ("cantonese", "zho"), ("portuguese", "por"), ("polish", "pol"), ("czech", "ces"), ("hungarian", "hun"), ("dutch", "nld"),
    ("korean", "kor"), ("arabic", "ara"), ("hindi", "hin"), ("turkish", "tur"), ("thai", "tha"), ("swedish", "swe"), ("norwegian", "nor"),
    ("danish", "dan"), ("finnish", "fin"), ("hebrew", "heb"), ("russian", "rus"), ("greek", "ell"), ("vietnamese", "vie"), ("indonesian", "ind"),
    ("malay", "msa"), ("ukrainian", "ukr"), ("romanian", "ron"), ("bulgarian", "bul"), ("croatian", "hrv"), ("serbian", "srp"), ("slovak", "slk"),
    ("slovenian", "slv"), ("estonian", "est"), ("latvian", "lav"), ("lithuanian", "lit"), ("icelandic", "isl"), ("basque", "eus"), ("catalan", "cat"), ("galician", "glg"),
)
CODEC_ALIASES = {"MLP": "TrueHD", "AC3": "Dolby Digital", "AC": "Dolby Digital", "DDL": "Dolby Digital Plus", "WAV": "PCM", "ATMOS": "Dolby Atmos"}


#: Names that audio codecs go by, and layouts as channels before and behind the dot.
AUDIO_BRANDS = {
    "TrueHD": "Dolby TrueHD", "AC-3": "Dolby Digital", "EAC-3": "Dolby Digital Plus", "DTS-HD MA": "DTS-HD Master Audio", "DTS-HD HR": "DTS-HD High Resolution",
    "DTS": "DTS", "LPCM": "LPCM", "AAC": "AAC", "MP2": "MPEG Audio", "MP3": "MP3", "FLAC": "FLAC", "Opus": "Opus",
}
LAYOUTS = {"mono": "1.0", "stereo": "2.0", "2.1": "2.1", "4.0": "4.0", "5.0": "5.0", "5.1": "5.1", "6.1": "6.1", "7.1": "7.1"}


def mapped(value: Column, table: dict, default=None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out if default is None else out.otherwise(default)


def codec(coding_type: Column) -> Column:
    """codec of a coding type."""
    return mapped(coding_type, CODECS, "Unknown")


def codec_kind(name: Column) -> Column:
    return mapped(name, CODEC_KINDS, "unknown")


def resolution(video_format: Column) -> Column:
    """resolution of a video format."""
    return mapped(video_format, RESOLUTIONS, "unknown")


def pixels(name: Column) -> Column:
    """width and height; full HD where unknown."""
    wide = mapped(name, {k: w for k, (w, _) in PIXELS.items()}, 1920)
    high = mapped(name, {k: h for k, (_, h) in PIXELS.items()}, 1080)
    return F.struct(wide.alias("width"), high.alias("height"))


def is_uhd(name: Column) -> Column:
    return name.isin("2160p", "4320p")


def is_hd(name: Column) -> Column:
    return name.isin("720p", "1080i", "1080p", "2160p", "4320p")


def is_interlaced(name: Column) -> Column:
    return name.isin("480i", "576i", "1080i")


def frame_rate(video_rate: Column) -> Column:
    """name and fraction of a video rate; 0/1 where unknown."""
    return F.struct(mapped(video_rate, {k: v[0] for k, v in FRAME_RATES.items()}, "unknown").alias("name"), mapped(video_rate, {k: v[1] for k, v in FRAME_RATES.items()}, 0).alias("num"), mapped(video_rate, {k: v[2] for k, v in FRAME_RATES.items()}, 1).alias("den"))


def channels(audio_format: Column) -> Column:
    return mapped(audio_format, {k: v[0] for k, v in CHANNELS.items()}, "unknown")


def channel_count(audio_format: Column) -> Column:
    """number of channels; an unknown layout counts as 6."""
    return mapped(audio_format, {k: v[1] for k, v in CHANNELS.items()}, 6)


def sample_rate_hz(audio_rate: Column) -> Column:
    """sample rate of an audio rate code; 48 kHz where unknown."""
    return mapped(audio_rate, SAMPLE_RATES, 48000)


def duration_display(seconds: Column) -> Column:
    """hours and minutes as `Xh MMm`."""
    minutes = F.floor(seconds / 60)
    return F.format_string("%dh %02dm", F.floor(minutes / 60), minutes % 60)


def _bcd(byte: Column) -> Column:
    high, low = F.shiftright(byte, 4), byte.bitwiseAND(F.lit(15))
    return F.when((high > 9) | (low > 9), 0).otherwise(high * 10 + low)


def bcd_to_secs(hour: Column, minute: Column, second: Column, frame: Column) -> Column:
    """F8: seconds of a BCD time; a byte that is no BCD counts as 0; the frame byte's top bits tell 25 (1) or 29.97 (3) frames a second."""
    flag, frames = F.shiftright(frame, 6), _bcd(frame.bitwiseAND(F.lit(63)))
    rest = F.when(flag == 1, frames / 25.0).when(flag == 3, frames / 29.97).otherwise(0.0)
    return _bcd(hour) * 3600 + _bcd(minute) * 60 + _bcd(second) + rest


def parse_timecode(text: Column, tick_base: int | Column = 60) -> Column:
    """seconds of HH:MM:SS:FF or MM:SS:FF, fields of digits only; null for others."""
    p = F.transform(F.split(text, ":"), lambda x: F.when(F.trim(x).rlike(r"^\+?[0-9]{1,9}$"), F.trim(x).cast("double")))
    n, at = F.size(p), lambda k: F.get(p, F.lit(k))
    return F.when(n == 4, at(0) * 3600 + at(1) * 60 + at(2) + at(3) / tick_base).when(n == 3, at(0) * 60 + at(1) + at(2) / tick_base)


def chapter_time(seconds: Column, digits: int = 9) -> Column:
    """HH:MM:SS with a fraction of the digits."""
    unit = 10**digits
    total = F.round(seconds * unit).cast("long")
    whole = F.floor(total / unit)
    return F.format_string(f"%02d:%02d:%02d.%0{digits}d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, total % unit)


def pts_to_ns(pts: Column) -> Column:
    """nanoseconds of 90 kHz ticks, rounded."""
    return ((pts * 100_000 + 4) / 9).cast("long")


def _byte(digits: Column, i: int) -> Column:
    return F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("int")


def ts_header(hex188: Column) -> Column:
    """fields of a transport packet given as hex: sync, pid, pusi, afc, cc; where its payload begins, null where it has none or its adaptation is
    too long; whether it tells of a discontinuity."""
    b = lambda i: _byte(hex188, i)
    afc = F.shiftright(b(3).bitwiseAND(F.lit(0x30)), 4)
    offset = F.when(afc == 1, 4).when((afc == 3) & (b(4) < 183), 5 + b(4))
    return F.struct(
        (b(0) == 0x47).alias("sync"), (b(1).bitwiseAND(F.lit(0x1F)) * 256 + b(2)).alias("pid"), (b(1).bitwiseAND(F.lit(0x40)) != 0).alias("pusi"), afc.alias("afc"), b(3).bitwiseAND(F.lit(15)).alias("cc"),
        offset.alias("payload_offset"), F.coalesce((afc == 3) & (b(4) > 0) & (b(5).bitwiseAND(F.lit(0x80)) != 0), F.lit(False)).alias("discontinuity"),
    )


def pes_time(digits: Column) -> Column:
    """33 bits of five bytes given as hex; null without all three marker bits."""
    b = lambda i: _byte(digits, i).cast("long")
    marked = (b(0) % 2 == 1) & (b(2) % 2 == 1) & (b(4) % 2 == 1)
    high = F.shiftright(b(0), 1).bitwiseAND(F.lit(7)) * (1 << 30) + b(1) * (1 << 22)
    return F.when(marked, high + F.shiftright(b(2), 1) * (1 << 15) + b(3) * (1 << 7) + F.shiftright(b(4), 1))


#: Ids of streams whose packets have no further header.
PLAIN_STREAMS = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)


def pes_header(digits: Column) -> Column:
    """pts, dts and header length of a PES packet given as hex; length 0 where it is none, 6 for streams without further header. The length may
    reach into the next packet."""
    n, b = F.length(digits) / 2, lambda i: _byte(digits, i)
    ours, plain = (n >= 9) & (F.substring(digits, 1, 6) == "000001"), b(3).isin(*PLAIN_STREAMS)
    flags, more = F.shiftright(b(7), 6), b(8)
    pts = F.when(ours & ~plain & (flags >= 2) & (more >= 5) & (n >= 14), pes_time(F.substring(digits, 19, 10)))
    dts = F.when(ours & ~plain & (flags == 3) & (more >= 10) & (n >= 19), pes_time(F.substring(digits, 29, 10)))
    return F.struct(pts.alias("pts"), dts.alias("dts"), F.when(~ours, 0).when(plain, 6).otherwise(9 + more).alias("header_len"))


def field_order(frame_picture: Column, progressive_sequence: Column, progressive_frame: Column, top_field_first: Column) -> Column:
    """progressive, or which field is shown first."""
    fields = F.when(top_field_first, "tff").otherwise("bff")
    return F.when(frame_picture & (progressive_sequence | progressive_frame), "progressive").otherwise(fields)


def nb_fields(frame_picture: Column, progressive_sequence: Column, progressive_frame: Column, top_field_first: Column, repeat_first_field: Column) -> Column:
    """field periods for which a picture is shown."""
    shown = F.when(progressive_sequence, F.when(top_field_first, 6).otherwise(4)).when(progressive_frame, 3).otherwise(2)
    return F.when(~frame_picture, 1).when(~repeat_first_field, 2).otherwise(shown)


def display_set_is_forced(digits: Column) -> Column:
    """whether a composition segment given as hex shows an object and its first is forced."""
    return F.coalesce((_byte(digits, 0) == 0x16) & (_byte(digits, 13) > 0) & (_byte(digits, 17).bitwiseAND(F.lit(0x40)) != 0), F.lit(False))


def dvd_audio_pid(sub_id: Column) -> Column:
    """F32: pid of a DVD audio sub-stream; null for others."""
    return F.when(sub_id.between(0x80, 0x8F) | sub_id.between(0xA0, 0xA7) | sub_id.between(0xC0, 0xC7), F.lit(0xBD00) + sub_id)


def dvd_subtitle_pid(sub_id: Column) -> Column:
    """F32: pid of a DVD subtitle sub-stream; null for others."""
    return F.when(sub_id.between(0x20, 0x3F), sub_id)


def dvd_audio_sub_id(codec_name: Column, place: Column) -> Column:
    """F32: sub-stream of the audio at a place from 0, at most 7."""
    first = F.when(codec_name == "AC-3", 0x80).when(codec_name == "DTS", 0x88).when(codec_name == "LPCM", 0xA0)
    return first + F.least(place, F.lit(7))


#: File extensions of elementary streams.
EXTENSIONS = {"HEVC": "hevc", "H.264": "h264", "VC-1": "vc1", "MPEG-2": "m2v", "TrueHD": "thd", "DTS-HD MA": "dtshd", "DTS-HD HR": "dtshd", "DTS": "dts", "AC-3": "ac3", "EAC-3": "eac3", "LPCM": "pcm", "FLAC": "flac", "PGS": "sup"}


def track_file(base: Column, place: Column, language_code: Column, codec_name: Column, delay_ms: Column) -> Column:
    """name of a track's file: base, place, language and codec as far as known, the delay where there is one, the extension."""
    delay = F.when(delay_ms != 0, F.format_string("DELAY %dms", delay_ms))
    stem = F.concat_ws(" ", sanitized_file_name(base), F.format_string("t%02d", place), F.when(language_code != "", language_code), codec_name, delay)
    return F.concat_ws(".", stem, mapped(codec_name, EXTENSIONS, "bin"))


LANGUAGE_NAMES = {code: name.capitalize() for name, code in reversed(LANGUAGES) if name not in ("mandarin", "cantonese")}


def normalized_language(text: Column) -> Column:
    """code of a language named in the text, else the trimmed text in lower case."""
    low = F.lower(F.trim(text))
    return F.coalesce(language(low)["code"], low)


def language_name(code: Column) -> Column:
    """English name of a language code; empty where it is unknown."""
    return mapped(code, LANGUAGE_NAMES, "")


def is_sd(name: Column) -> Column:
    return name.isin("480i", "480p", "576i", "576p")


def source_position(byte: Column) -> Column:
    """sector and the byte inside it."""
    return F.struct(F.floor(byte / 2048).alias("sector"), (byte % 2048).alias("byte"))


def has_word(text: Column, word: str) -> Column:
    """Whether the lower-case text has the word with no letter or digit beside it."""
    return text.rlike(rf"(?<![\p{{L}}\p{{N}}]){word}(?![\p{{L}}\p{{N}}])")


def language(text: Column) -> Column:
    """code and variant of the language a text names: compound names first in their order, then whole words."""
    low = F.lower(text)
    tried = [F.when(F.contains(low, F.lit(n)), F.struct(F.lit(c).alias("code"), F.lit(v).alias("variant"))) for n, c, v in COMPOUND_LANGUAGES]
    tried += [F.when(has_word(low, n), F.struct(F.lit(c).alias("code"), F.lit("").alias("variant"))) for n, c in LANGUAGES]
    return F.coalesce(*tried)


def purpose(text: Column) -> Column:
    """F16: purpose that a text names."""
    low = F.lower(text)
    return (
        F.when(low.contains("audio description") | low.contains("descriptive service"), "Descriptive").when(low.contains("music only"), "Score").when(has_word(low, "commentary"), "Commentary")
        .when(has_word(low, "descriptive") | has_word(low, "description") | has_word(low, "described"), "Descriptive").when(has_word(low, "score"), "Score").when(has_word(low, "ime"), "Ime").otherwise("Normal")
    )


def qualifier(text: Column) -> Column:
    """F16: qualifier that a text names."""
    low = F.lower(text)
    return F.when(has_word(low, "sdh") | has_word(low, "captions"), "Sdh").when(low.contains("descriptive service") | has_word(low, "rnib"), "DescriptiveService").when(has_word(low, "forced"), "Forced").otherwise("None")


def codec_alias(code: Column) -> Column:
    """display name of a codec token; others pass."""
    return F.coalesce(mapped(F.upper(code), CODEC_ALIASES), code)


def codec_hint_consistent(hint: Column, codec_name: Column) -> Column:
    """whether a label's hint names the stream's codec, an extension that it carries, or no codec at all."""
    h = F.lower(hint)
    says = lambda *words: h.rlike("|".join(w.replace("+", r"\+") for w in words))
    truehd, plus = says("truehd", "true hd"), says("ac-3+", "ac3+", "e-ac-3", "eac-3", "eac3", "digital plus", "dd+")
    ac3 = ~plus & says("ac-3", "ac3", "dolby digital")
    master, high = says("master audio", "hd ma"), says("high resolution", "hd hr")
    dts, pcm, atmos, dts_x = ~master & ~high & says("dts"), says("pcm"), says("atmos"), says("dts:x", "dts-x", "dtsx")
    family = truehd | plus | ac3 | master | high | dts | pcm
    named = (
        F.when(codec_name == "TrueHD", truehd | atmos).when(codec_name == "EAC-3", plus | atmos).when(codec_name == "AC-3", ac3).when(codec_name == "DTS-HD MA", master | dts_x)
        .when(codec_name == "DTS-HD HR", high | dts_x).when(codec_name == "DTS", dts).when(codec_name == "LPCM", pcm).otherwise(True)
    )
    return F.when(family, named).otherwise(~atmos | codec_name.isin("TrueHD", "EAC-3"))


def codec_hint_adds_detail(hint: Column) -> Column:
    """whether a hint tells of sound objects, which codec names cannot."""
    return F.lower(hint).rlike("atmos|dts:x|dts-x|dtsx")


def audio_label(codec_name: Column, channel_layout: Column, atmos: Column | None = None) -> Column:
    """brand of an audio codec with its layout; empty for other codecs, without the layout where that is unknown."""
    brand, layout = mapped(codec_name, AUDIO_BRANDS), mapped(channel_layout, LAYOUTS)
    if atmos is not None:
        brand = F.when(atmos & codec_name.isin("TrueHD", "EAC-3"), F.concat(brand, F.lit(" Atmos"))).otherwise(brand)
    return F.when(brand.isNull(), "").otherwise(F.concat_ws(" ", brand, layout))


def video_label(codec_name: Column, width: Column, height: Column, interlaced: Column, hdr: Column, secondary: Column) -> Column:
    """codec, size and HDR format of a video; of a secondary one only that it is the Dolby Vision layer."""
    scan = F.when(interlaced, "i").otherwise("p")
    size = (
        F.when(width >= 7680, "8K").when(width >= 3840, "4K").when(width >= 1920, F.concat(F.lit("1080"), scan)).when(width >= 1280, "720p")
        .when(height >= 576, F.concat(F.lit("576"), scan)).when(height >= 480, F.concat(F.lit("480"), scan))
    )
    whole = F.concat_ws(" ", codec_name, size, F.when(hdr != "SDR", hdr))
    return F.when(secondary, F.when(hdr == "Dolby Vision", "Dolby Vision EL").otherwise("")).otherwise(whole)


def progress_percent(done: Column, total: Column, empty: float) -> Column:
    """percentage, clamped; `empty` where the total is 0."""
    return F.when(total == 0, F.lit(empty)).otherwise(F.least(F.greatest(done * 100.0 / total, F.lit(0.0)), F.lit(100.0)))


def ecc_sectors(disc_format: Column) -> Column:
    """sectors of an error correction block."""
    return F.when(disc_format == "DVD", 16).otherwise(32)


def error_category(code: Column) -> Column:
    """thousands of an error code."""
    return F.floor(code / 1000)


def is_secondary_cell(block_mode: Column) -> Column:
    """a cell inside an angle block that is not the block's first."""
    return block_mode.isin(2, 3)


def mask_string(text: Column) -> Column:
    """letters as A, digits as 0."""
    return F.regexp_replace(F.regexp_replace(text, "[A-Za-z]", "A"), "[0-9]", "0")


def sanitized_component(name: Column) -> Column:
    """a path component as a host file system takes it: without dots and spaces at its end, device names marked by `_`; null for `.`,
    `..`, names with an illegal mark or control character, and those of which nothing is left."""
    clean = F.regexp_replace(name, r"[. ]+$", "")
    bad = name.isin(".", "..") | name.rlike(r'[<>:"|?*/\\\x00-\x1f]') | (clean == "")
    device = F.upper(F.substring_index(clean, ".", 1)).rlike(r"^(CON|PRN|AUX|NUL|CONIN\$|CONOUT\$|CLOCK\$|COM[1-9]|LPT[1-9])$")
    return F.when(~bad, F.when(device, F.concat(F.lit("_"), clean)).otherwise(clean))


def sanitized_file_name(name: Column) -> Column:
    """a file name with `_` for the marks that paths do not take."""
    return F.regexp_replace(name, r'[/\\:*?"<>|]', "_")


def vts_group(name: Column) -> Column:
    """group of a DVD title set's file, as `VTS_01`; null for others."""
    group = F.regexp_extract(F.upper(name), r"^VTS_([0-9]{2})(?:_|$)", 1)
    return F.when(group != "", F.concat(F.lit("VTS_"), group))


def is_title_vob(name: Column) -> Column:
    """whether a file is a title's VOB, parts 1 to 9; part 0 is the menu."""
    return F.upper(name).rlike(r"_[1-9](?:\.VOB)+$")


def playlist_number(name: Column) -> Column:
    """number of a playlist file."""
    return F.regexp_extract(name, r"^(\d+)\.", 1).try_cast("int")


def layers(capacity_sectors: Column) -> Column:
    """two layers above 24,000,000 sectors."""
    return F.when(capacity_sectors > 24_000_000, 2).otherwise(1)


def next_action(nontried: Column, retryable: Column, total: Column) -> Column:
    """what to do next with a disc."""
    return F.when(total.isNull(), "sweep").when(nontried > 0, "resume_sweep").when(retryable > 0, "patch").otherwise("done")
