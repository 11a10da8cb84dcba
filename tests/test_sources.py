"""Extraction, cleaning and verification on files built here, damaged ones included."""

import base64
import struct

import pytest
from pyspark.sql import functions as F

from tracewash.plans.fixtures import EXPECTED, FORMS, NAMES, REFUSED, chunk
from tracewash.sources import cleaning, files, metadata

SECRET = b"Jane Secret 00000007"
BUILT = {NAMES.get(k, f"a.{k}").replace("a.", f"{k}."): f(SECRET) for k, f in FORMS.items()}


def frame(spark, rows):
    """``file_id, name, file_type, content`` of (name, content) pairs."""
    rows = [(str(i), name, bytearray(content)) for i, (name, content) in enumerate(rows)]
    df = spark.createDataFrame(rows, "file_id string, name string, content binary")
    return df.select("file_id", "name", files.file_type(F.col("name")).alias("file_type"), "content")


def cleaned(spark, rows):
    return {r.file_id: r for r in cleaning.cleaned(metadata.with_parts(frame(spark, rows))).select("file_id", "name", "error_code", "cleaned").collect()}


def test_scan_items_clean_and_clean_again(spark, tmp_path):
    for name, content in BUILT.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "fake.pdf").write_bytes(b"<html>300</html>")
    (tmp_path / "what.xyz").write_bytes(b"?")
    (tmp_path / "old.msg").write_bytes(b"\xd0\xcf\x11\xe0 outlook")
    walked = metadata.with_parts(files.scan(spark, str(tmp_path)))
    found = {}
    for r in walked.select("file_id", "name").join(metadata.items(walked), "file_id").collect():
        found.setdefault(r.name.split(".")[0], []).append((r.field, r.value, r.risk))
    for kind, want in EXPECTED.items():
        assert sorted(map(str, found[kind])) == sorted(str((f, v and v.replace("*", SECRET.decode()), r)) for f, v, r in want)
    rows = {r.name: r for r in cleaning.cleaned(walked).collect()}
    for name in BUILT:
        kind = name.split(".")[0]
        assert rows[name].error_code == REFUSED.get(kind)
        assert kind in REFUSED or bytes(rows[name].cleaned) == FORMS[kind](None), name
    assert rows["fake.pdf"].error_code == "NOT_PDF" and rows["old.msg"].error_code.startswith("DAMAGED") and rows["what.xyz"].cleaned is None
    assert {r.name for r in files.rejects(spark, str(tmp_path), 20_000).collect() if r.error_code == "UNKNOWN_TYPE"} == {"what.xyz"}
    again = cleaned(spark, [(n, r.cleaned) for n, r in rows.items() if r.cleaned is not None])
    assert all(bytes(r.cleaned) == bytes(rows[r.name].cleaned) for r in again.values())


def test_files_cut_at_every_place_keep_no_secret(spark):
    rows = []
    for name, content in BUILT.items():
        step = max(1, len(content) // 400)
        rows += [(name, content[:n]) for n in range(0, len(content), step)]
    got = cleaned(spark, rows)
    assert len(got) == len(rows)
    for i, (name, _) in enumerate(rows):
        r = got[str(i)]
        assert (r.cleaned is None) == (r.error_code is not None)
        if r.cleaned is not None and not name.startswith("office"):
            assert SECRET not in bytes(r.cleaned) and base64.b64encode(SECRET)[:24] not in bytes(r.cleaned), (name, i)


def test_many_parts_and_long_values(spark):
    png = FORMS["png"](None)[:-12]
    late = png + chunk(b"IDAT", b"") * 20_000 + chunk(b"tEXt", b"Author\0" + SECRET) + chunk(b"IEND", b"")
    broken = png + b"\x7f\xff\xff\xff" + b"tEXtAuthor\0" + SECRET + chunk(b"IEND", b"")
    long = b"%PDF-1.4\n1 0 obj<</Author (" + b"x(y)" * 250_000 + SECRET + b")>>endobj trailer<</Info 1 0 R>>%%EOF"
    hexed = b"%PDF-1.4\n1 0 obj<</Author <" + SECRET.hex().encode() + b">>>endobj trailer<</Info 1 0 R>>%%EOF"
    locked = b"%PDF-1.4\n1 0 obj<</Author (x)>>endobj trailer<</Info 1 0 R /Encrypt 9 0 R>>%%EOF"
    folds = b"From: a@b\r\nReceived: x" + b"\r\n " * 20_000 + SECRET + b"\r\nSubject: s\r\n\r\nbody"
    mail = b"Reply-To: " + SECRET + b"\nX-Spam-Score: " + b"9" * 1_000_000 + b"\nSubject: s\n\nbody"
    entity = b"<svg><!-- " + SECRET * 50_000 + b"--></svg>"
    garbage = FORMS["jpeg"](SECRET).replace(b"\xff\xfe", b"zz\xff\xfe", 1)
    boxes = FORMS["mp4"](SECRET) + struct.pack(">I4s", 8, b"free") * 20_000
    cycle = b"II*\0" + struct.pack("<IHHHIII", 8, 1, 0x010F, 2, 20, 26, 8) + SECRET
    rows = [("a.png", late), ("b.png", broken), ("c.pdf", long), ("d.pdf", hexed), ("e.pdf", locked), ("f.eml", folds), ("g.eml", mail), ("h.svg", entity), ("i.jpg", garbage), ("j.mp4", boxes), ("k.tiff", cycle), ("l.svg", b"<svg><x></svg>"), ("m.gif", b"")]
    got = {r.name: r for r in cleaned(spark, rows).values()}
    errors = {n for n, r in got.items() if r.error_code}
    assert errors == {"b.png", "e.pdf", "i.jpg", "l.svg", "m.gif"} and got["e.pdf"].error_code == "PDF_ENCRYPTED"
    for n, r in got.items():
        assert n in errors or SECRET not in bytes(r.cleaned) and SECRET.hex().encode() not in bytes(r.cleaned), n
    assert bytes(got["g.eml"].cleaned) == b"Subject: s\n\nbody" and bytes(got["f.eml"].cleaned) == b"From: a@b\r\nSubject: s\r\n\r\nbody"
    walked = metadata.with_parts(frame(spark, rows[:4]))
    values = {r.value for r in metadata.items(walked).where("field = 'Author'").collect()}
    assert values == {SECRET.decode(), "x(y)" * 250_000 + SECRET.decode()}


def test_scans_labels_and_attachments(spark):
    tiff = b"MM\0*" + struct.pack(">IH", 8, 2) + struct.pack(">HHII", 0x011A, 5, 1, 38) + struct.pack(">HHII", 0x010E, 2, 8, 46) + bytes(4) + struct.pack(">II", 300, 1) + b"my scan\0"
    exif = b"Exif\0\0" + tiff
    photo = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xda\0\x02x\xff\xd9"
    walked = metadata.with_parts(frame(spark, [("a.jpg", photo), ("b.eml", FORMS["eml"](SECRET)), ("c.m4a", FORMS["m4a"](SECRET))]))
    got = {(r.file_id, r.field): r for r in metadata.items(walked).collect()}
    assert got["0", "PrinterTracking"].risk == "high" and got["0", "XResolution"].value == "300.00" and got["0", "ImageDescription"].label == "Description"
    assert got["2", "©too"].label == "Encoder"
    assert metadata.attachment_counts(walked).collect()[0][1:] == (1, 1)


def test_arriving_files(spark, tmp_path):
    from tracewash.streaming import arrivals

    (tmp_path / "in").mkdir()
    for name in ("one.png", "copy.png"):
        (tmp_path / "in" / name).write_bytes(BUILT["png.png"])
    (tmp_path / "in" / "b.gif").write_bytes(BUILT["gif.gif"])
    run = lambda: arrivals.keep_scores(spark, str(tmp_path / "in"), str(tmp_path / "scores"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert run() and spark.read.parquet(str(tmp_path / "scores")).where("n_items > 0").count() == 2
    (tmp_path / "in" / "late.wav").write_bytes(BUILT["wav.wav"])
    (tmp_path / "in" / "again.gif").write_bytes(BUILT["gif.gif"])
    assert run() and spark.read.parquet(str(tmp_path / "scores")).count() == 3


def test_sinks(spark, tmp_path):
    import io
    import json
    import zipfile

    from tracewash.operators import results
    from tracewash.sources import sinks

    walked = metadata.with_parts(frame(spark, [("png.png", BUILT["png.png"]), ("heic.heic", BUILT["heic.heic"]), ("gif.gif", BUILT["gif.gif"])]))
    assert {r.name for r in cleaning.ready(walked).collect()} == {"png.png", "gif.gif"}
    done = cleaning.cleaned(walked)
    sinks.write_results(done, str(tmp_path / "done"))
    back = {r.name: r for r in spark.read.parquet(str(tmp_path / "done")).collect()}
    assert bytes(back["png.png"].cleaned) == FORMS["png"](None) and back["heic.heic"].cleaned is None and back["heic.heic"].error_code
    issued = results.certificates(done.where("cleaned is not null"))
    sinks.write_certificates(issued, str(tmp_path / "certificates"))
    assert spark.read.json(str(tmp_path / "certificates/json")).count() == 2
    assert spark.read.text(str(tmp_path / "certificates/text")).where("value = 'File: gif.gif'").count() == 1
    rows = {r.file_id: r for r in sinks.report(done, metadata.items(walked)).collect()}
    assert rows["0"].report.startswith("File: png.png\nStatus: SUCCESS") and "[high] Author: Jane Secret 00000007" in rows["0"].report
    assert json.loads(rows["1"].report_json)["status"] == "FAILED HEIC_DECODE_UNSUPPORTED"
    archives = sinks.archives(done, issued, most_bytes=50).collect()
    names = [n for a in archives for n in zipfile.ZipFile(io.BytesIO(a.zip)).namelist()]
    assert len(archives) > 1 and sorted(n for n in names if n != "summary.txt") == ["certificates/0.json", "certificates/2.json", "cleaned_files/0/clean_png.png", "cleaned_files/2/clean_gif.gif"]
    one = sinks.archives(done.join(cleaning.verified(done), "file_id", "left"), issued).collect()
    assert len(one) == 1
    told = zipfile.ZipFile(io.BytesIO(one[0].zip)).read("summary.txt").decode()
    files_of = [n.split("/")[1] for n in zipfile.ZipFile(io.BytesIO(one[0].zip)).namelist() if n.startswith("cleaned_files")]
    assert told.startswith("Files: 2") and "Verified: 2 of 2" in told and told.index({"0": "png.png", "2": "gif.gif"}[files_of[0]]) < told.index({"0": "png.png", "2": "gif.gif"}[files_of[1]])
    assert spark.range(1).select(sinks.gps_text(F.lit(1.5), F.lit(-2.25))).first()[0] == "1.500000, -2.250000"


def test_table_function(spark):
    from tracewash.sources import registry

    registry.register(spark)
    frame(spark, [("a.png", BUILT["png.png"]), ("b.gif", b"GIF89a")]).createOrReplaceTempView("some_files")
    got = {(r.name, r.kind, r.key) for r in spark.sql("SELECT name, p.kind, p.key FROM some_files, LATERAL metadata_parts(name, content) p").collect()}
    assert ("a.png", "tEXt", "Author") in got and ("b.gif", "error", "Damaged") in got


def test_screenshots_from_items_and_values(spark):
    from tracewash.functions import values
    from tracewash.operators import items, screenshots

    rows = [("f", 0, "PixelXDimension", "1170"), ("f", 1, "PixelYDimension", "2532"), ("f", 2, "Make", "Apple"), ("g", 0, "Software", "Editor")]
    found = screenshots.from_items(spark.createDataFrame(rows, "file_id string, ord int, field string, value string"), spark.createDataFrame([("f", "x.png"), ("g", "y.png")], "file_id string, name string"))
    shots = screenshots.detect(found)
    assert {(r.file_id, r.confidence, r.platform, r.is_screenshot) for r in shots.collect()} == {("f", 50, "iPhone", True), ("g", 0, None, False)}
    assert {tuple(r) for r in screenshots.recommendations(shots).collect()} == {("f", "device,timestamp,screen,apple")}
    risk = spark.createDataFrame([("f", 10, "low"), ("g", 10, "low"), ("h", 80, "critical")], "file_id string, score int, level string")
    assert {(r.file_id, r.score, r.level) for r in items.with_screenshot_floor(risk, shots).collect()} == {("f", 60, "high"), ("g", 10, "low"), ("h", 80, "critical")}
    one = spark.createDataFrame([(" a \n b ", "x" * 80, 1_700_000_000_000, "p.PNG", "S")], "t string, b string, ms long, name string, ref string")
    got = one.select(values.one_line(F.col("t")), values.truncated(F.col("b"), 3), values.neutral_name(F.col("ms"), F.col("name")), values.wrapped_base64(F.col("b").cast("binary")), values.dms_to_decimal(F.lit(41), F.lit(30), F.lit(36), F.col("ref"))).first()
    assert got[0] == "a b" and got[1] == "xxx..." and got[2] == "shared_loyw3v28.png" and got[3].split("\r\n") == [base64.b64encode(b"x" * 80).decode()[:76], base64.b64encode(b"x" * 80).decode()[76:]] and got[4] == -41.51


def test_archives_fill_up_one_after_the_other(spark):
    from tracewash.sources import sinks

    rows = spark.range(3000).selectExpr("cast(id as string) as file_id", "id % 97 + 1 as size")
    got = sorted((r.place, r.archive, r["size"]) for r in sinks.packed(rows, 1000).collect())
    assert [p for p, *_ in got] == list(range(1, 3001))
    total = 0
    for _, archive, size in got:
        assert archive == total // 1000
        total += size


def mail(*parts, edge=b"edge"):
    head = b"From: a@b\r\nContent-Type: multipart/mixed; boundary=" + edge + b"\r\n\r\n"
    return head + b"".join(b"--" + edge + b"\r\n" + p + b"\r\n" for p in parts) + b"--" + edge + b"--\r\n"


def test_large_attachments_keep_their_boundaries(spark):
    photo = FORMS["png"](None)[:-12] + chunk(b"IDAT", bytes(2 * 2**20)) + chunk(b"tEXt", b"Author\0" + SECRET) + chunk(b"IEND", b"")
    wrap = lambda x: base64.encodebytes(x).replace(b"\n", b"\r\n").rstrip()
    part = lambda x: b"Content-Type: image/png\r\nContent-Transfer-Encoding: base64\r\n\r\n" + wrap(x)
    text = b"Content-Type: text/plain\r\n\r\nlast words"
    clean = FORMS["png"](None)[:-12] + chunk(b"IDAT", bytes(2 * 2**20)) + chunk(b"IEND", b"")
    got = cleaned(spark, [("a.eml", mail(part(photo), text, part(FORMS["png"](SECRET))))])["0"]
    assert got.error_code is None and bytes(got.cleaned) == mail(part(clean), text, part(FORMS["png"](None)))


def test_files_in_files_to_a_stated_depth(spark):
    def nested(n, s):
        inner = FORMS["png"](s)
        body = b"Content-Type: image/png\r\nContent-Transfer-Encoding: base64\r\n\r\n" + base64.b64encode(inner)
        for k in range(n):
            body = b"Content-Type: message/rfc822\r\n\r\n" + (b"Reply-To: " + s + b"\r\n" if s else b"") + mail(body, edge=b"edge%d" % k)
        return mail(body)

    walked = metadata.with_parts(frame(spark, [("a.eml", nested(2, SECRET)), ("b.eml", nested(4, SECRET))]))
    got = {r.name: r for r in cleaning.cleaned(walked, deepest=4).collect()}
    assert bytes(got["a.eml"].cleaned).count(b"--\r\n") == 3 and SECRET not in bytes(got["a.eml"].cleaned) and base64.b64encode(FORMS["png"](None))[:76] in bytes(got["a.eml"].cleaned)
    assert got["b.eml"].cleaned is None and got["b.eml"].error_code.endswith("TOO_DEEP")
    zipped = mail(b'Content-Type: application/zip\r\nContent-Disposition: attachment; filename="a.zip"\r\n\r\nPK')
    left = cleaning.parts_left(metadata.with_parts(frame(spark, [("c.eml", zipped)]))).collect()
    assert [(r.name, r.mime) for r in left] == [("a.zip", "application/zip")]


def test_pdf_strings_wherever_they_stand(spark):
    import zlib

    def stream(number, entries, data, packed=True):
        data = zlib.compress(data) if packed else data
        return b"%d 0 obj<<%s /Length %d%s>>stream\n" % (number, entries, len(data), b" /Filter /FlateDecode" if packed else b"") + data + b"\nendstream endobj\n"

    info = b"<</Author (" + SECRET + b") /Company 9 0 R /Nested [(" + SECRET + b")]>>"
    text = b"<</Kept (Visible words)>>"
    numbers = b"1 0 8 %d 9 %d " % (len(info) + 1, len(info) + len(text) + 2)
    held = stream(7, b"/Type /ObjStm /N 3 /First %d" % len(numbers), numbers + info + b" " + text + b" (" + SECRET + b")")
    xmp = stream(5, b"/Type /Met#61data", b"<x:xmpmeta>" + SECRET + b"</x:xmpmeta>")
    older = b"1 0 obj<</Title (" + SECRET + b")>>endobj\n"
    file = b"%PDF-1.5\n" + older + held + xmp + b"trailer<</Inf#6f 1 0 R>>\n%%EOF"
    odd = file.replace(b"/FlateDecode>>stream", b"/LZWDecode>>stream", 1)
    escaped = b"%PDF-1.4\n1 0 obj<</Author (Jane\\040Secret\\)) /Producer <FEFF004A0061006E0065>>>endobj trailer<</Info 1 0 R>>%%EOF"
    rows = [("a.pdf", file), ("b.pdf", odd), ("c.pdf", escaped)]
    walked = metadata.with_parts(frame(spark, rows))
    values = {(r.file_id, r.field, r.value) for r in metadata.items(walked).where("src = 'info'").collect()}
    said = SECRET.decode()
    assert values == {("0", "Title", said), ("0", "Author", said), ("0", "Company", said), ("0", "Nested", said), ("2", "Author", "Jane Secret)"), ("2", "Producer", "Jane")}
    done = cleaning.cleaned(walked)
    got = {r.name: r for r in done.collect()}
    assert got["b.pdf"].cleaned is None and got["b.pdf"].error_code.startswith("DAMAGED")
    new = bytes(got["a.pdf"].cleaned)
    assert len(new) == len(file)
    from tracewash.sources.pdfs import Objects

    objects = Objects(new)
    assert objects.body(8).strip() == text and SECRET not in objects.body(9) and SECRET not in new
    assert SECRET not in b"".join(objects.data(*span) for spans in objects.spans.values() for span in spans if b"stream" in new[span[0] : span[1]])
    assert {r.file_id: r.n_traces for r in cleaning.verified(done).collect()} == {"0": 0, "2": 0}


def test_the_verifier_finds_what_a_cleaner_leaves(spark):
    photo, film = FORMS["jpeg"](SECRET, 1), FORMS["mp4"](SECRET, 1)
    rows = [("a.jpg", photo, photo), ("b.mp4", film, film), ("c.flac", FORMS["flac"](SECRET, 1), FORMS["flac"](SECRET, 1)), ("d.pdf", FORMS["pdf"](SECRET, 1), FORMS["pdf"](SECRET, 1))]
    rows += [("e.wav", FORMS["wav"](SECRET, 1), FORMS["wav"](SECRET, 1)), ("f.svg", FORMS["svg"](SECRET, 1), FORMS["svg"](SECRET, 1)), ("g.tiff", FORMS["tiff"](SECRET, 2), FORMS["tiff"](SECRET, 2)), ("h.png", FORMS["png"](SECRET, 1), FORMS["png"](None, 1) + b"<x:xmpmeta")]
    rows += [("i.png", FORMS["png"](SECRET, 1), FORMS["png"](None, 1)), ("j.eml", FORMS["eml"](SECRET), FORMS["eml"](None)), ("k.jpg", photo, FORMS["jpeg"](None, 1) + SECRET.decode().encode("utf-16-le"))]
    df = spark.createDataFrame([(str(i), n, bytearray(a), bytearray(b)) for i, (n, a, b) in enumerate(rows)], "file_id string, name string, content binary, cleaned binary")
    found = {rows[int(r.file_id)][0]: r.traces for r in cleaning.traces(df.withColumn("file_type", files.file_type(F.col("name")))).collect()}
    assert {n for n, t in found.items() if not t} == {"i.png", "j.eml"}
    assert SECRET.decode() in found["k.jpg"] and SECRET.decode() in found["d.pdf"] and SECRET.decode() in found["g.tiff"]


def test_fragmented_films_and_wide_tables(spark):
    from tracewash.plans.fixtures import box

    film = FORMS["mp4"](SECRET, 1)
    more = box(b"moof", box(b"mfhd", bytes(8)) + box(b"traf", box(b"tfhd", bytes(8)))) + box(b"mdat", b"more") + box(b"uuid", SECRET)
    spread = film + more
    telemetry = FORMS["mp4"](SECRET, 2) + more
    got = {r.name: r for r in cleaned(spark, [("a.mp4", spread), ("b.mp4", telemetry)]).values()}
    assert len(got["a.mp4"].cleaned) == len(spread) and SECRET not in bytes(got["a.mp4"].cleaned) and bytes(got["a.mp4"].cleaned)[spread.index(b"frames") :][:6] == b"frames"
    assert got["b.mp4"].cleaned is None and got["b.mp4"].error_code == "UNKNOWN_PART"
    wide = film.replace(box(b"stco", bytes(4) + struct.pack(">II", 1, film.index(b"frames"))), box(b"co64", bytes(4) + struct.pack(">IQ", 1, film.index(b"frames"))))
    # The tables above it are four bytes larger each, and so are the boxes around.
    grown = bytearray(wide)
    for name in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
        at = wide.index(name) - 4
        grown[at : at + 4] = struct.pack(">I", struct.unpack(">I", wide[at : at + 4])[0] + 4)
    at = wide.index(b"co64") + 12
    grown[at : at + 8] = struct.pack(">Q", wide.index(b"frames"))
    new = bytes(cleaned(spark, [("c.mp4", bytes(grown))])["0"].cleaned)
    at = new.index(b"co64") + 12
    assert struct.unpack(">Q", new[at : at + 8])[0] == new.index(b"frames") and SECRET not in new


def test_sound_of_other_kinds(spark):
    aac = b"".join(b"\xff\xf1\x50\x80" + bytes([0x01, 0x9F, 0xFC]) + b"x" * 5 for _ in range(4))  # 12 bytes a frame
    slow = (b"\xff\xf3\x40\x00" + bytes(100)) * 3  # MPEG-2, 32 kbit/s, 22,050 Hz: 104 bytes a frame
    rows = [("a.aac", SECRET + aac), ("b.mp3", slow[:-2] + SECRET), ("c.mp3", SECRET * 9), ("d.flac", FORMS["flac"](SECRET) + b"TAG" + SECRET.ljust(125, b"\0"))]
    got = {r.name: r for r in cleaned(spark, rows).values()}
    assert bytes(got["a.aac"].cleaned) == aac and bytes(got["b.mp3"].cleaned)[:310] == slow[:-2] and got["c.mp3"].error_code.startswith("DAMAGED")
    assert bytes(got["d.flac"].cleaned) == FORMS["flac"](None)


def test_damaged_files_fail_no_job_and_tell(spark):
    import io
    import random
    import zipfile

    rnd, rows = random.Random(2), []
    for kind, form in FORMS.items():
        for shape in range(4):
            for _ in range(8):
                b = bytearray(form(SECRET, shape))
                for _ in range(2):
                    b[rnd.randrange(len(b))] = rnd.randrange(256)
                rows.append((NAMES.get(kind, f"a.{kind}"), bytes(b)))
    torn = bytearray(FORMS["office"](SECRET))
    torn[torn.index(b"a.png") + 8] ^= 0xFF  # the member's data, its place intact
    rows.append(("torn.docx", bytes(torn)))
    walked = metadata.with_parts(frame(spark, rows))
    done = cleaning.cleaned(walked).select("file_id", "name", "file_type", "content", "error_code", "cleaned").cache()
    got = done.collect()
    assert len(got) == len(rows) and all((r.cleaned is None) == (r.error_code is not None) for r in got)
    assert next(r for r in got if r.name == "torn.docx").error_code.startswith("INNER_")
    assert cleaning.verified(done).count() == sum(r.cleaned is not None for r in got)
    one, other = FORMS["pdf"](SECRET).replace(b"/Info", b"/Xnfo"), FORMS["tiff"](SECRET, 3).replace(struct.pack("<HH", 0x0117, 4), struct.pack("<HH", 0x0118, 4))
    film = FORMS["mp4"](SECRET, 2)
    at = film.rindex(b"stsz")
    film = film[: at + 12] + struct.pack(">I", 7) + film[at + 16 :]
    sound = bytearray(FORMS["flac"](SECRET, 1))
    sound[45] = 0x18 + 4 + 43  # a block that ends where frames are yet to come
    new = {r.name: r for r in cleaned(spark, [("a.pdf", one), ("b.tiff", other), ("c.mp4", film), ("d.flac", bytes(sound))]).values()}
    assert SECRET not in bytes(new["a.pdf"].cleaned) and new["b.tiff"].error_code == "UNKNOWN_PART" and new["c.mp4"].error_code.startswith("DAMAGED") and new["d.flac"].error_code.startswith("DAMAGED")
    assert zipfile.is_zipfile(io.BytesIO(FORMS["office"](SECRET)))


def test_svg_entities_and_local_paths(spark):
    plain = b'<!DOCTYPE svg [<!ENTITY ns_svg "http://www.w3.org/2000/svg">]><svg xmlns="&ns_svg;"><a href="C:\\Users\\Jane"/><g onclick="x()" id="k"/></svg>'
    told = plain.replace(b"http://www.w3.org/2000/svg", SECRET)
    got = {r.name: r for r in cleaned(spark, [("a.svg", plain), ("b.svg", told)]).values()}
    assert bytes(got["a.svg"].cleaned) == plain.replace(b' href="C:\\Users\\Jane"', b"").replace(b' onclick="x()"', b"")
    assert got["b.svg"].error_code == "UNKNOWN_PART" and got["b.svg"].cleaned is None


def test_formats_that_users_add(spark):
    from tracewash.sources import registry

    def notes(b):
        at = 4
        for line in b[4:].splitlines(True):
            key, _, value = line.decode().partition("=")
            yield "note line", key, at, at + len(line), value.strip()
            at += len(line)

    new = registry.Format("notes", "note", notes, magic="4E4F5445", risk=lambda p: F.when(p["key"] == "who", "high"), edit=lambda p: F.when(p["key"] == "who", "drop"))
    registry.add_format(new)
    try:
        rows = [("a.note", b"NOTEwho=Jane\nwhat=words\n"), ("b.note", b"none"), ("c.png", FORMS["png"](SECRET))]
        walked = metadata.with_parts(frame(spark, rows))
        assert [(r.field, r.value, r.risk) for r in metadata.items(walked).where("file_id = '0'").collect()] == [("who", "Jane", "high")]
        got = {r.name: r for r in cleaned(spark, rows).values()}
        assert bytes(got["a.note"].cleaned) == b"NOTEwhat=words\n" and got["b.note"].error_code == "NOT_NOTES" and bytes(got["c.png"].cleaned) == FORMS["png"](None)
        registry.register(spark)
        frame(spark, rows).createOrReplaceTempView("noted_files")
        assert {r.key for r in spark.sql("SELECT p.key FROM noted_files, LATERAL metadata_parts(name, content) p WHERE p.kind = 'note line'").collect()} == {"who", "what"}
        with pytest.raises(ValueError):
            registry.add_format(registry.Format("png", "png", notes))
    finally:
        registry.remove_format("notes")
        registry.register(spark)


def test_comments_of_users_in_their_encodings(spark):
    def tagged(raw):
        exif = struct.pack("<HHHII", 1, 0x9286, 7, len(raw), 44) + bytes(4)
        return b"II*\0" + struct.pack("<IHHHIII", 8, 1, 0x8769, 4, 1, 26, 0) + exif + raw

    rows = [("a.tiff", tagged(b"ASCII\0\0\0Jane")), ("b.tiff", tagged(b"UNICODE\0" + "Jané".encode("utf-16-le"))), ("c.tiff", tagged(b"JIS\0\0\0\0\0" + "山".encode("iso2022_jp")))]
    got = metadata.items(metadata.with_parts(frame(spark, rows))).where("field = 'UserComment'").collect()
    assert {r.file_id: r.value for r in got} == {"0": "Jane", "1": "Jané", "2": "山"}


def test_built_files_are_dealt_to_all_tasks(spark, monkeypatch):
    from conftest import folder
    from tracewash.plans import fixtures

    made = fixtures.built(spark, folder("sf0.01"), "wav")
    counts = [r["count"] for r in made.select("file_id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) >= spark.sparkContext.defaultParallelism and sum(counts) == 2000 and max(counts) < 2 * sum(counts) / len(counts)
    monkeypatch.setattr(fixtures, "EACH", 100)
    assert fixtures.built(spark, folder("sf0.01"), "wav").rdd.getNumPartitions() == 20


def test_cleaned_files_are_walked_once_more_to_verify_them(spark, monkeypatch):
    rows = [(name, content) for name, content in BUILT.items() if name.split(".")[0] in ("png", "gif", "wav", "pdf", "tiff", "mp3")]
    done = cleaning.cleaned(metadata.with_parts(frame(spark, rows))).cache()
    calls = []
    monkeypatch.setattr(cleaning, "with_parts", lambda df: calls.append(df.columns) or metadata.with_parts(df))
    with_them = sorted(map(str, cleaning.verified(done).collect()))
    assert len(calls) == 1 and len(with_them) == len(rows)
    assert with_them == sorted(map(str, cleaning.verified(done.drop("parts", "walked", "error_code")).collect()))
    # what stays is found alike: as if nothing had gone
    same = done.withColumn("cleaned", F.col("content"))
    assert sorted(map(str, cleaning.traces(same).collect())) == sorted(map(str, cleaning.traces(same.drop("parts", "walked", "error_code")).collect()))


def test_search_one_by_one_equals_the_automaton(monkeypatch):
    content = b"ab" + b"Jane Secret 1\0" * 3 + "Jané Nobody".encode("utf-16-le") + b"http://ns.adobe.com/" + bytes(50)
    search = lambda cleaned: cleaning._searched(content, cleaned, "jpeg", [(2, 60)], ["Jane Secret 1", "Jané Nobody"])
    few = search(content), search(b"nothing")
    monkeypatch.setattr(cleaning, "FEW", 0)
    assert few == (search(content), search(b"nothing")) and few[0] and not few[1]


def test_files_are_opened_in_the_task_that_walks_them(spark):
    held = dict(BUILT)
    opened = lambda by: held[by.decode()]
    whole = frame(spark, list(BUILT.items()))
    named = whole.withColumn("content", F.encode("name", "utf-8"))
    walked, there = metadata.with_parts(whole), metadata.with_parts(named, opened)
    assert max(len(r.content) for r in there.collect()) < 30
    columns = ("file_id", "error_code", "parts")
    assert sorted(map(str, there.select(*columns).collect())) == sorted(map(str, walked.select(*columns).collect()))


def test_checked_equals_cleaned_and_verified(spark):
    held = dict(BUILT) | {"cut.png": BUILT["png.png"][:-30], "none.pdf": b"<html>", "a.xyz": b"?", "old.heic": BUILT["heic.heic"]}
    opened = lambda by: held[by.decode()]
    whole = frame(spark, list(held.items()))
    done = cleaning.cleaned(metadata.with_parts(whole)).cache()
    seals = done.select("file_id", "error_code", F.sha2("cleaned", 256).alias("cleaned_sha256"))
    want = sorted(map(str, seals.join(cleaning.verified(done), "file_id", "left").collect()))
    named = metadata.with_parts(whole.withColumn("content", F.encode("name", "utf-8")), opened)
    assert sorted(map(str, cleaning.checked(named, opened).collect())) == want
    assert sorted(map(str, cleaning.checked(metadata.with_parts(whole)).collect())) == want
    bad = done.withColumn("cleaned", F.col("content"))
    assert {r.verified for r in cleaning.verified(bad).where("n_bad > 0").collect()} == {False}


def test_outer_files_are_dealt_to_tasks_when_inner_ones_come_back(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "EACH", 10)
    rows = [(f"{k}.docx", FORMS["office"](SECRET)) for k in range(120)]
    done = cleaning.cleaned(metadata.with_parts(frame(spark, rows)))
    tasks = [r["count"] for r in done.select("file_id", "cleaned").groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 6 and sum(tasks) == 120


def test_frames_that_are_alike_are_measured_once(monkeypatch):
    from tracewash.sources import walkers

    calls, measure = [], walkers._frame
    monkeypatch.setattr(walkers, "_frame", lambda b, at: calls.append(at) or measure(b, at))
    parts = list(walkers.mp3(FORMS["mp3"](SECRET, 3)))
    assert len(calls) < 20 and [p[0] for p in parts].count("junk") == 1
    adts = lambda n: b"\xff\xf1\x50\x80" + (n << 5).to_bytes(2, "big") + bytes(n - 6)
    sound = adts(40) + adts(50) + b"Jane" + adts(40) + adts(60)
    assert [(p[2], p[3]) for p in walkers._between_frames(sound, 0, len(sound))] == [(90, 94)]


def test_dictionaries_of_a_pdf_are_read_once(monkeypatch):
    from tracewash.sources import pdfs

    read, calls = pdfs._dictionary, []
    monkeypatch.setattr(pdfs, "_dictionary", lambda b, at, stop: calls.append((bytes(b), at, stop)) or read(b, at, stop))
    list(pdfs.pdf(FORMS["pdf"](SECRET)))
    assert len(calls) < 15
    tokens = [t for t, *_ in pdfs._tokens(b" % (no) <<\n<< /A#20b(x(%)y) % end\n[1 <41>]>>\0 ", 0, 46)]
    assert tokens == [b"<<", b"/A#20b", b"(x(%)y)", b"[", b"1", b"<41>", b"]", b">>"] and pdfs._name(tokens[1]) == "A b"


def test_parts_are_judged_once_and_by_the_rules_of_their_kind(spark):
    from conftest import folder
    from tracewash.plans import catalog

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    general = plan(metadata.items(metadata.with_parts(frame(spark, [("a.eml", FORMS["eml"](SECRET))]))).select("field", "value", "risk"))
    assert general.count("dkim-signature") == 2 and "Filter" not in general  # one pattern names it twice
    own = plan(catalog.QUERIES["extract_eml"](spark, folder("sf0.001")))
    assert own.count("dkim-signature") == 2 and "VP8X" not in own and "inkscape" not in own and "SampleRate" not in own


def test_boundaries_of_mail_are_those_of_whole_lines():
    import re

    from tracewash.sources import texts

    bodies = [b"--b\n\nx\n--b--", b"a--b\n--b \t\r\n\r\n--bx\n --b\n--b--\r\n", b"\n--b--\r\n--b\r--b\n--b--\t", b"--b----b\n--b--", b"--b" * 9, b"\n--b--x"]
    for body in bodies:
        want = [m.span() for m in re.finditer(rb"(?m)^--b(?:--)?[ \t]*\r?$\n?", body)]
        whole = b"--b\nhead" + body + b"\n--b tail"
        assert [(a - 8, z - 8) for a, z in texts._edges(whole, b"--b", 8, 8 + len(body))] == want


def test_plain_packages_are_read_like_zipfile_reads_them(monkeypatch):
    import io
    import zipfile

    from tracewash.plans.fixtures import zipped
    from tracewash.sources import walkers

    members = [("docProps/core.xml", "<a><b>1</b><c/></a>"), ("word/media/a.png", b"\x89" * 400), ("docProps/app.xml", "<a><Company>W</Company>")]
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    assert zipped(members) == made.getvalue()

    def parts(b):
        found = []
        try:
            found += [p for p in iter(lambda g=walkers.office(b): next(g, None), None) if not found.append(p)]
        except Exception as e:
            found.append(type(e).__name__)
        return found

    files = [FORMS["office"](SECRET, k) for k in range(4)] + [made.getvalue(), made.getvalue() + b"x", b"x" + made.getvalue(), made.getvalue().replace(b"core", b"cose", 1)]
    files += [made.getvalue()[:k] + bytes([made.getvalue()[k] ^ 1]) + made.getvalue()[k + 1 :] for k in range(0, len(made.getvalue()), 3)]
    quick = [parts(b) for b in files]
    with monkeypatch.context() as m:
        m.setattr(walkers, "_plain_members", lambda b: None)
        assert [parts(b) for b in files] == quick
    monkeypatch.setattr(walkers.zipfile, "ZipFile", None)
    assert [parts(b) for b in files[:4]] == quick[:4] and ["docProps/core.xml", "b", 0, 0, "1"] == list(quick[4][0])


def test_tags_without_attributes_are_not_read_again(monkeypatch):
    from tracewash.sources import texts

    class Counted:
        tags = []

        def finditer(self, tag):
            self.tags.append(tag)
            return pattern.finditer(tag)

    pattern = texts._ATTRIBUTE
    monkeypatch.setattr(texts, "_ATTRIBUTE", Counted())
    b = '<svg xmlns="s"><g><title>\n a  b c </title></g><g xmlns:q="q"><t data-é="é" q:z="1"/><q:u/> </g></svg>'.encode()
    parts = list(texts.svg(b))
    assert [(p[0], p[1], b[p[2] : p[3]].decode().strip(), p[4]) for p in parts if p[0] != "title"] == [("namespace", "", 'xmlns:q="q"', None), ("attribute", "data-é", 'data-é="é"', "é"), ("attribute", "q:z", 'q:z="1"', "1"), ("editor", "q:u", "<q:u/>", None)]
    assert [p[4] for p in parts if p[0] == "title"] == ["a b c"] and len(Counted.tags) == 3


def test_patterns_of_the_jpeg_walker_are_compiled_before(monkeypatch):
    from tracewash.sources import walkers

    want = list(walkers.jpeg(FORMS["jpeg"](SECRET, 3)))
    for name in ("compile", "findall"):
        monkeypatch.setattr(walkers.re, name, None)
    assert list(walkers.jpeg(FORMS["jpeg"](SECRET, 3))) == want and ("comment", "Jane Secret 00000007") in [(p[1], p[4]) for p in want]


def test_samples_and_holders_of_a_film_are_not_copied():
    from tracewash.plans.fixtures import box
    from tracewash.sources import walkers

    class Read(bytes):
        most = 0

        def __getitem__(self, k):
            out = bytes.__getitem__(self, k)
            Read.most = max(Read.most, len(out)) if isinstance(out, bytes) else Read.most
            return out

    film = FORMS["m4a"](SECRET) + box(b"mdat", bytes(100_000)) + box(b"moov", box(b"free", b"") * 1000)
    parts = list(walkers.mp4(Read(film)))
    assert Read.most < 1000 and ("ilst", "©too", "Jane Secret 00000007") in [(p[0], p[1], p[4]) for p in parts]
    inside = box(b"moov", box(b"udta", box(b"mdat", b"\0\3\0\0abc") + box(b"ilst", box(b"minf", bytes(4) + b"data" + bytes(8) + b"x"))))
    assert [(p[1], p[4]) for p in walkers.mp4(inside)] == [("moov", None), ("udta", None), ("mdat", "abc"), ("ilst", None), ("minf", "x"), ("data", None)]


def test_built_packages_make_what_their_shape_holds_alone(monkeypatch):
    from tracewash.plans import fixtures

    monkeypatch.setattr(fixtures, "jpeg", None)
    assert all(fixtures.office(SECRET, k)[:2] == b"PK" for k in (0, 1, 2))
    with pytest.raises(TypeError):
        fixtures.office(SECRET, 3)
