"""Queries of the reader views, over annotation rows that stand on the part table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotloom.plans.registry import query
from plotloom.sources import views as W


def annotation_rows(t) -> DataFrame:
    """Rows with the fields of every reader."""
    k, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    text = k.cast("string")
    said = lambda v: F.struct(v.alias("value"))
    box = F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.4))
    word = F.struct(brand.alias("word"), F.struct(F.lit(0.1).alias("top_left_x"), F.lit(0.2).alias("top_left_y"), F.lit(0.3).alias("width"), F.when(k % 4 == 0, 0.9).otherwise(0.4).alias("height")).alias("bounding_box"))
    fields = {
        "image": F.concat(F.when(k % 3 == 0, "val/COCO_").otherwise("train/COCO_"), text, F.lit(".jpg")), "image_id": text, "instance_id": text, "question": name, "question_id": F.concat(F.lit("q"), text), "answers_": F.array(brand),
        "choices": F.array(brand, F.lit("x")), "correct_choice_idx": F.lit(0), "direct_answers": F.array(brand), "image_path": F.concat(F.lit("a/b"), text, F.lit(".png")), "analysis": F.concat(F.lit("why\nAnswer:"), brand),
        "grounded_caption": F.concat(F.lit("g "), name), "detailed_caption": name, "caption": F.when(k % 2 == 0, F.array_join(F.array_repeat(name, 40), " ")).otherwise(name), "img_id": F.concat(F.lit("i"), text), "sents": name, "inputs": name, "targets": brand,
        "instances": F.array(F.struct(name.alias("instruction_with_input"), F.when(k % 2 == 0, "be brief").alias("constraints"), brand.alias("output"))), "conversations": F.array(said(F.concat(F.lit("<image>\n"), name)), said(brand), said(F.lit("more")), said(F.lit("yes"))), "id": text,
        "qa_id": text, "deck_name": F.lit("deck"), "evidence_pages": F.when(k % 2 == 0, F.array(F.lit(4))).otherwise(F.array(F.lit(4), F.lit(5))), "key": text, "imageURL": F.lit("http://x/y.gif"), "split": F.when(k % 2 == 0, "train").otherwise("val"), "questions": F.array(name, F.lit("who")),
        "answers": F.array(brand, F.lit("me")), "bbox_": F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(40.0)), "utf8_string": brand, "width": F.when(k % 2 == 0, 100.0).otherwise(200.0), "height": F.lit(100.0), "image_index": text, "question_string": name,
        "caption_str": name, "ocr_info": F.array(word), "sample": text, "noun_chunks": F.array(F.concat(F.array(F.lit(0.0), F.lit(4.0)), box)), "ref_exps": F.array(F.concat(F.array(F.lit(0.0), F.lit(4.0)), box)), "objects": F.array(brand), "bbox": F.array(box), "phrase": name, "x": F.lit(20.0), "y": F.lit(30.0),
        "image_width": F.lit(400.0), "image_height": F.lit(200.0), "data_id": text, "instructions": F.array(name), "action": F.array(F.lit("left"), F.lit("right")), "n_steps": F.lit(3), "stroke": F.array(*(F.lit(float(v)) for v in (1, 2, 3, 4, 0.5, 0, 1, 0))), "strokes": F.array(F.array_repeat(F.lit(0.2), 13)), "tag": F.lit("[detail]"),
        "captions": F.array(name), "loc_y": F.lit(3), "loc_x": F.lit(5), "rgb": F.array(F.lit(1), F.lit(2), F.lit(3)), "file_name": F.concat(text, F.lit(".jpg")), "refers": F.array(name), "mask": F.lit(1), "video_id": text, "q": name, "a": brand, "q1": name, "q2": brand, "videoid": text, "name": F.concat(F.lit("x-y:"), name), "page_dir": F.lit("p"),
        "vid_name": text, "show_name": F.lit("Castle"), **{f"a{i}": F.lit(str(i)) for i in range(5)}, "answer_idx": F.lit("2"), "img": text, "text": name, "label": F.when(k % 2 == 0, 1).otherwise(0), "frames": F.lit("<F>"),
    }
    return t("part").select(k, *(v.alias(n) for n, v in fields.items()))


def samples(rows: DataFrame, name: str) -> DataFrame:
    """(reader, p_partkey, image, asked, answer) of one reader; what it lacks is null."""
    view = W.VIEWS[name]
    kinds = dict(f.split(":", 1) for f in _fields(view.schema))
    own = rows
    if kinds.get("answer", "").startswith("array"):
        own = own.withColumn("answer", F.col("answers_"))
    elif "answer" in kinds:
        own = own.withColumn("answer", F.get("answers_", 0))
    if kinds.get("answers", "").startswith("array<struct"):
        own = own.withColumn("answers", F.transform("answers", lambda a: F.struct(a.alias("answer"))))
    if kinds.get("bbox") == "array<double>":
        own = own.withColumn("bbox", F.col("bbox_"))
    if kinds.get("split") == "int":
        own = own.withColumn("split", F.when(F.col("split") == "train", 1).otherwise(2))
    if view.scan == "keyed_pairs":
        own = W.question_pairs(own)
    out = view.over(own, F.md5(F.concat_ws("|", F.col("p_partkey").cast("string"), F.lit(name))), ["p_partkey"])
    first = lambda *names: next((F.col(c) for c in names if c in out.columns), F.lit(None)).cast("string")
    asked, answer = first("instruction_input", "question", "conv_q", "image_id"), first("answer", "labels", "conv_a", "answers", "question_id", "img_id", "instance_id")
    return out.select(F.lit(name).alias("reader"), "p_partkey", first("image").alias("image"), asked.alias("asked"), answer.alias("answer"))


def _fields(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def _clean(x: str) -> str:
    return f"array_to_string(string_split(trim(regexp_replace(regexp_replace(lower({x}), '[.!\"()*#:;~]', ' ', 'g'), ' {{2,}}', ' ', 'g')), ' ')[1:50], ' ')"


_I = "'<Img><ImageHere></Img> ' || "
_CAP = "CASE WHEN k % 2 = 0 THEN array_to_string(list_transform(range(40), lambda i: n), ' ') ELSE n END"
_N, _B = _clean("n"), _clean("b")


def _drawn(reader: str, pool: tuple[str, ...], value: str = "", around: str = W.X.IMAGE + " {} ") -> str:
    """A reader's template with a value in it, drawn by the MD5 of the row's key."""
    quoted = ", ".join("'" + p.replace("'", "''") + "'" for p in pool)
    text = f"[{quoted}][('0x' || md5(md5(k || '|{reader}'))[1:8])::BIGINT % {len(pool)} + 1]"
    head, _, tail = around.partition("{}")
    return f"'{head}' || " + (f"replace({text}, '{{}}', {value})" if value else text) + f" || '{tail}'"


_SHORT = "'[vqa] Based on the image, respond to this question with a short answer: ' || n"
_BOX = "'{<10><20><30><40>}'"
_PHRASE = f"substr({_CAP}, 1, 4)"
_CAPTIONS = tuple("[caption] " + p for p in W.CAPTION)
_LISTED = "'" + W.LIST_OBJECTS + "'"
_TRAIN14 = "'COCO_train2014_' || k || '.jpg'"
#: (reader, image, asked, answer, which rows)
_LEGS = [
    ("AOKVQAReasoningDataset", "'b' || k || '.png'", f"{_I}'[vqa] ' || {_N} || ' '", "b", ""),
    ("COCOVQAEvalDataset", "img", f"{_I}'Question: ' || {_N} || ' Short answer: '", "'q' || k", ""),
    ("GQAEvalDataset", "img", f"{_I}'[vqa] Based on the image, respond to this question with a short answer: ' || {_N} || ' '", "b", ""),
    ("GroundedCaptionReasonDataset", "file", f"{_I}'[vqa] ' || {_N}", "b", ""),
    ("CaptionReasonDataset", "file", f"{_I}'[reasoning] ' || {_N}", "'g ' || n || ' short answer: ' || b", ""),
    ("ReasoningDataset", "k || '.jpg'", f"{_I}n || ' '", "b", ""),
    ("OCRVQADataset", "k || '.gif'", f"{_I}'Q: ' || {_N} || ' A:  '", _B, "k % 2 = 0"),
    ("OCRVQADataset", "k || '.gif'", f"{_I}'Q: who A:  '", "'me'", "k % 2 = 0"),
    ("TextOCRDataset", "k || '.jpg'", f"{_I}CASE WHEN k % 2 = 0 THEN '[OCR]  <10><20><40><60>' ELSE '[OCR]  <5><20><20><60>' END", "b", ""),
    ("PlotVQADataset", "k || '.png'", f"'Q: ' || {_I}n || '  A:'", "b", ""),
    ("CaptionDataset", "lpad(k::VARCHAR, 12, '0') || '.jpg'", "k::VARCHAR", _clean(_CAP), ""),
    ("COCOCapEvalDataset", "img", "'' || k", "k::VARCHAR", ""),
    ("CCSBUAlignDataset", "k || '.jpg'", "k::VARCHAR", _CAP, ""),
    ("CCSBUDataset", "k || '.jpg'", "NULL", _clean(_CAP), ""),
    ("EvalCaptionData", "file", "'[caption] please describe this image?'", "NULL", ""),
    ("TextCapBboxToObjectDataset", "k || '.jpg'", f"{_I}'[OCR] {{<10><20><40><60>}}'", "b", "k % 4 <> 0"),
    ("RefCOCOEvalData", "'i' || k || '.jpg'", "'[refer] where is ' || n || '?'", "'i' || k", ""),
    ("LlavaDetailDataset", "'COCO_train2014_' || k || '.jpg'", f"{_I}{_N} || ' '", "b", ""),
    ("LlavaConversationDataset", "'COCO_train2014_' || k || '.jpg'", f"{_I}n || ' !@#more'", "b || '!@#yes'", ""),
    ("CoTDataset", "NULL", "n", "b", ""),
    ("UnnaturalDataset", "NULL", "n || CASE WHEN k % 2 = 0 THEN ' be brief' ELSE '' END", "b", ""),
    ("NavR2RDataset", "k || '/0.jpg,' || k || '/1.jpg'", "'Command: ' || n || chr(10) || chr(10) || '<ImageHere> A: !@#<ImageHere> A: '", "'left!@#right'", ""),
    ("PaintPTCOCODataset", "k || '.jpg'", "'<Image><ImageHere><Canvas><ImageHere> Next Stroke: '", "'(1,2,3,4,90,0,255,0)'", ""),
    ("PaintLanRLOpaqueCOCODataset", "k || '.jpg'", "'Task: ' || n || chr(10) || 'Canvas: <ImageHere> Action: '", "'[detail]0(51,51,51,51,51,51,51,51,51,51,51)'", ""),
    ("PaintPixelCOCODataset", "file", f"{_I}'[reconstruct] loc: [3,5] rgb: '", "'[1,2,3]'", "k % 3 <> 0"),
    ("SegReferCOCODataset", "k || '.jpg'", f"{_I}'[segmentation] ' || n || ' loc: [3,5] mask: '", "'1'", "k % 2 = 0"),
    ("WebVidDataset", "'p/' || k || '.mp4'", "'<F>' || chr(10) || " + _drawn("WebVidDataset", W.VIDEO, "", "{}"), "n", ""),
    ("VideoChatGPTDataset", "k || '.mp4'", "'<F>' || chr(10) || n", "b", ""),
    ("TVQAEVAL", "'castle_frames/' || k", "'<F>' || chr(10) || n || ' ' || chr(10) || chr(10) || ' As you watched in this video Choose ONE suitable answer from these mutiple choices ' || chr(10) || chr(10) || array_to_string(list_transform(range(5), lambda i: 'option ' || i || ': ' || i || ' ' || chr(10) || chr(10)), '') || chr(10) || ' Your output should be THE NUMBER OF THE CORRECT ANSWER FROM THE CHOICES FROM 0 TO 4 INCLUSIVE'", "'2'", ""),
    ("OKVQAEvalData", "lpad(k::VARCHAR, 12, '0') || '.jpg'", "'[vqa] Based on the image, respond to this question with a short answer: ' || n", "'q' || k", ""),
    ("VizWizEvalData", "img", "'[vqa] Based on the image, respond to this question with a short answer: ' || n || ' and reply ''unanswerable'' if you could not answer it'", "b || '_me'", ""),
    ("IconQAEvalData", "k || '/image.png'", "'[vqa] Based on the image, respond to this question with a short answer: ' || n", "b", ""),
    ("HMEvalData", "k::VARCHAR", "'[vqa] This is an image with: \"' || n || '\" written on it. Is it hateful? Answer:'", "CASE WHEN k % 2 = 0 THEN '1' ELSE '0' END", ""),
    ("AOKVQADataset", "file", _drawn("AOKVQADataset", W.VQA, _N), _B, ""),
    ("AOKVQGDataset", "file", _drawn("AOKVQGDataset", W.QUESTION_FOR, "b", "{}"), _N, ""),
    ("AOKVQGReasoningDataset", "'b' || k || '.png'", _drawn("AOKVQGReasoningDataset", W.QUESTION_FOR, "b", "{}"), _N, ""),
    ("COCOVQADataset", "file", _drawn("COCOVQADataset", W.VQA, _N), _B, ""),
    ("COCOVQGDataset", "file", _drawn("COCOVQGDataset", W.QUESTION_FOR, "b", W.X.IMAGE + " {}"), _N, ""),
    ("GQADataset", "img", _drawn("GQADataset", W.VQA, _N), _B, ""),
    ("VQADataset", "img", "n", "b", ""),
    ("VQAEvalDataset", "img", "n", "'q' || k", ""),
    ("textVQAEvalDataset", "img", f"{_I}'[vqa] Based on the image, respond to this question with a short answer: ' || {_N} || ' '", "b || '_me'", ""),
    ("SingleSlideVQADataset", "'deck/slide_4_1024.jpg'", _drawn("SingleSlideVQADataset", W.SLIDE, _N, "{}"), "b", "k % 2 = 0"),
    ("COCOCaptionDataset", "file", _drawn("COCOCaptionDataset", _CAPTIONS), _clean(_CAP), "k % 3 <> 0"),
    ("CaptionEvalDataset", "img", "k::VARCHAR", "k::VARCHAR", ""),
    ("NoCapsEvalDataset", "img", "'i' || k", "k::VARCHAR", ""),
    ("LaionDataset", "k || '.jpg'", _drawn("LaionDataset", _CAPTIONS), _clean(_CAP), ""),
    ("TextCapDataset", "k || '.jpg'", _drawn("TextCapDataset", _CAPTIONS), _N, ""),
    ("LocNaCOCODataset", "lpad(k::VARCHAR, 12, '0') || '.jpg'", _drawn("LocNaCOCODataset", W.LONG_CAPTION, "", "###Human: {} ###Assistant: "), _CAP, f"len(string_split({_CAP}, ' ')) >= 60"),
    ("GroundedDetailDataset", _TRAIN14, _drawn("GroundedDetailDataset", W.DETAIL), "'g ' || n", ""),
    ("COYOCaptionWDSDataset", "k || '.jpg'", _drawn("COYOCaptionWDSDataset", W.GROUNDED), _clean(f"replace({_CAP}, {_PHRASE}, '<p>' || {_PHRASE} || '</p> ' || {_BOX})"), ""),
    ("COYOBoxToPhraseWDSDataset", "k || '.jpg'", _drawn("COYOBoxToPhraseWDSDataset", W.IDENTIFY, _BOX), _clean(_PHRASE), ""),
    ("COYOPhraseToBoxWDSDataset", "k || '.jpg'", _drawn("COYOPhraseToBoxWDSDataset", W.REFER, _clean(_PHRASE)), _BOX, ""),
    *((r, "k || '.jpg'", f"{_I}{_clean(_LISTED)}", _clean("'{' || b || ',<10><20><40><60>}'"), "") for r in ("LVISBBOXDataset", "OpenImageDataset")),
    *((r, "k || '.jpg'", _drawn(r, W.OBJECT_AT, "'{<10><20><40><60>}'"), _B, "") for r in ("LVISBboxToObjectDataset", "OpenBboxToObjectDataset")),
    ("ReferVisualGenomeDataset", "k || '.jpg'", _drawn("ReferVisualGenomeDataset", W.REFER, _N), "'{<5><15><30><65>}'", "k % 2 = 0"),
    ("LlavaReasonDataset", _TRAIN14, f"{_I}{_N} || ' '", "b", ""),
    ("PaintRLCOCODataset", "k || '.jpg'", "'<Image><ImageHere><Canvas><ImageHere> Action: '", "'[detail]0(" + ",".join(["51"] * 13) + ")'", ""),
    ("CMDVideoDataset", "k || '.mp4'", "'<F>' || chr(10) || " + _drawn("CMDVideoDataset", W.VIDEO, "", "{}"), _CAP, ""),
    ("VideoChatGPTEvalDataset", "k || '.mp4'", "'<F>' || chr(10) || n", "b", ""),
    ("Video_validation_Dataset", "k || '.mp4'", "'<F>' || chr(10) || n", "b", ""),
    ("VideoChatGPTEval_consistancy", "k || '.mp4'", "'<F>' || chr(10) || n", "b", ""),
    ("Video_loader_template", "'videos/' || k || '.mp4'", "'<F>' || chr(10) || n", "b", ""),
    ("AOKVQADAEvalData", "img", _SHORT, "'q' || k", ""),
    ("AOKVQAMCEvalData", "img", _SHORT, "'q' || k", ""),
    ("GQAEvalData", "img", _SHORT, "b", ""),
    ("VSREvalData", "img", f"'[vqa] Based on the image, is this statement true or false? ' || {_CAP}", "CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END", ""),
]
_ROWS = "WITH r AS (SELECT p_partkey k, p_name n, p_brand b, CASE WHEN p_partkey % 3 = 0 THEN 'val/COCO_' ELSE 'train/COCO_' END || p_partkey || '.jpg' img, 'COCO_' || p_partkey || '.jpg' AS file FROM part) "
_SQL = " UNION ALL ".join(f"SELECT '{r}' reader, k p_partkey, {i} image, {a} asked, {w} answer FROM r" + (f" WHERE {o}" if o else "") for r, i, a, w, o in _LEGS)


def all_samples(t) -> DataFrame:
    rows = annotation_rows(t)
    return reduce(DataFrame.unionByName, [samples(rows, name) for name in W.VIEWS])


@query(_ROWS + _SQL)
def reader_samples(t):
    return all_samples(t)


@query(_ROWS + f", s AS ({_SQL}) SELECT reader, count(*) n, sum(('0x' || md5(concat_ws('|', p_partkey, coalesce(image, '~'), coalesce(asked, '~'), coalesce(answer, '~')))[1:8])::BIGINT)::BIGINT digest FROM s GROUP BY 1")
def all_readers(t):
    """Each reader's own number of samples, and the sum of a digest of each."""
    text = F.concat_ws("|", F.col("p_partkey").cast("string"), *(F.coalesce(c, F.lit("~")) for c in ("image", "asked", "answer")))
    digest = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return all_samples(t).groupBy("reader").agg(F.count("*").alias("n"), F.sum(digest).alias("digest"))


@query(_ROWS + "SELECT kind, k p_partkey, asked FROM r, (VALUES " + ", ".join(f"({i}, 'slide', '{p}')" for i, p in enumerate(("<Img><ImageHere></Img> {}", "<Img><ImageHere></Img> From this slide, {}"))) + ") p(i, kind, tpl), LATERAL (SELECT replace(tpl, '{}', " + _N + ") asked) WHERE k % 2 = 0 AND ('0x' || md5(md5(k || '|SingleSlideVQADataset'))[1:8])::BIGINT % 2 = i UNION ALL SELECT 'vqa', k, '<Img><ImageHere></Img> ' || replace(tpl, '{}', " + _N + ") || ' ' FROM r, (VALUES (0, '[vqa] {}'), (1, '[vqa] Based on the image, respond to this question with a short answer: {}')) p(i, tpl) WHERE ('0x' || md5(md5(k || '|GQADataset'))[1:8])::BIGINT % 2 = i")
def drawn_templates(t):
    rows = annotation_rows(t)
    kinds = (("slide", "SingleSlideVQADataset"), ("vqa", "GQADataset"))
    return reduce(DataFrame.unionByName, [samples(rows, n).select(F.lit(k).alias("kind"), "p_partkey", "asked") for k, n in kinds])
