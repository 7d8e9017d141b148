"""Training and evaluation samples as views: each reader is a scan, a filter and a projection of annotation rows.

A view's columns are texts; an image is the path of its file, as pixels are no rows. Random choices of the readers (a template, one of several
answers) are made by the MD5 of the row, so that a table always gives the same samples.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotloom.functions import media as X
from plotloom.functions import numbers as N
from plotloom.functions import text as T
from plotloom.sources import scans as S

# The instruction templates of the readers.
SHORT_ANSWER = "[vqa] Based on the image, respond to this question with a short answer: {}"
VQA = ("[vqa] {}", SHORT_ANSWER)
QUESTION_FOR = (
    "Given the image, generate a question whose answer is: {}",
    "Based on the image, provide a question with the answer: {}",
    'Given the visual representation, create a question for which the answer is "{}"',
    "From the image provided, craft a question that leads to the reply: {}",
    "Considering the picture, come up with a question where the answer is: {}",
    "Taking the image into account, generate an question that has the answer: {}",
)
CAPTION = (
    "Briefly describe this image.",
    "Provide a concise depiction of this image.",
    "Present a short description of this image.",
    "Summarize this image in a few words.",
    "A short image caption:",
    "A short image description:",
    "A photo of ",
    "An image that shows ",
    "Write a short description for the image. ",
    "Write a description for the photo.",
    "Provide a description of what is presented in the photo.",
    "Briefly describe the content of the image.",
    "Can you briefly explain what you see in the image?",
    "Could you use a few words to describe what you perceive in the photo?",
    "Please provide a short depiction of the picture.",
    "Using language, provide a short account of the image.",
    "Use a few words to illustrate what is happening in the picture.",
)
GROUNDED = (
    "[grounding] Briefly describe this image with grounding objects.",
    "[grounding] Provide a concise depiction of this image with grounding objects.",
    "[grounding] Present a short description of this image with grounding objects.",
    "[grounding] Summarize this image in a few words with grounding objects.",
    "[grounding] A short image caption with grounding objects:",
    "[grounding] A short image description with grounding objects:",
    "[grounding] Write a short description for the image with grounding objects.",
    "[grounding] Write a description for the photo with grounding objects.",
    "[grounding] Briefly describe the content of the image with grounding objects.",
    "[grounding] Please provide a short depiction of the picture with grounding objects.",
)
DETAIL = (
    "[grounding] please describe this image in details",
    "[grounding] describe this image as detailed as possible",
    "[grounding] summarize this image in details",
    "[grounding] give a thorough description of what you see in this image",
)
IDENTIFY = (
    "[identify] {}",
    "[identify] what object is in this location {}",
    "[identify] identify the object present at this location {}",
    "[identify] what is it in {}",
    "[identify] describe this object in {}",
    "[identify] this {} is",
    "[identify] the object in {} is",
)
REFER = (
    "[refer] {}",
    "[refer] give me the location of {}",
    "[refer] where is {} ?",
    "[refer] from this image, tell me the location of {}",
    "[refer] the location of {} is",
    "[refer] could you tell me the location for {} ?",
    "[refer] where can I locate the {} ?",
)
OBJECT_AT = (
    "what object is in this bounding box location {} ",
    "what object is in this location {} ",
    "identify the object present at this location {} ",
    "what is it in bounding box location{} ",
    "describe this object in {} ",
    "this {} is ",
    "the object in {} is ",
    "please tell me what is inside the bounding box position {} ",
    "what can you find in the bounding box area at position {}? ",
    "what is the object occupying this area {} ",
    "could you identify the content within the bounding box located at {} ",
)
LIST_OBJECTS = "Given an image, identify the objects and their bounding boxes in the format of {object,x1 y1 x2 y2}. "
SLIDE = (X.IMAGE + " {}", X.IMAGE + " From this slide, {}")
LONG_CAPTION = (
    X.IMAGE + " Describe this image in detail.",
    X.IMAGE + " Take a look at this image and describe what you notice.",
    X.IMAGE + " Please provide a detailed description of the picture.",
    X.IMAGE + " Could you describe the contents of this image for me?",
)
VIDEO = (
    "Describe this video.",
    "Provide a concise depiction of this video.",
    "Present a description of this video.",
    "Summarize this video.",
    "Generate video caption:",
    "Generate video description:",
    "Write a description for the video.",
    "Provide a description of what is presented in the video.",
    "Describe the content of the video.",
    "Can you explain what you see in the video?",
    "Could you describe what you perceive in the video?",
    "Please provide a depiction of the video.",
    "Illustrate what is happening in the video.",
)
SHOW_FOLDERS = {"Grey's Anatomy": "grey_frames", "How I Met You Mother": "met_frames", "Friends": "friends_frames", "The Big Bang Theory": "bbt_frames", "House M.D.": "house_frames", "Castle": "castle_frames"}

_QA = "image:string,image_id:string,question:string,question_id:string,answer:array<string>"
_AOK = "image:string,question:string,question_id:string,choices:array<string>,correct_choice_idx:int,direct_answers:array<string>"
_BOXED = "objects:array<string>,bbox:array<array<double>>"
_CHUNKS = "id:string,caption:string,noun_chunks:array<array<double>>,ref_exps:array<array<double>>"
_TALK = "id:string,conversations:array<struct<value:string>>"
_VIDEO = "video_id:string,q:string,a:string"


@dataclass(frozen=True)
class View:
    """scan: how the rows are read; schema: their fields; columns: the sample's columns over them; where: which rows count."""

    name: str
    scan: str
    schema: str
    columns: Callable[[], dict[str, Column]]
    where: Callable[[], Column] | None = None
    field: str | None = None

    def over(self, rows: DataFrame, key: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """The samples of annotation rows, behind the columns ``keep`` of theirs; draws go by ``key``, or else by the whole row."""
        own = rows.withColumn("_key", F.md5(F.to_json(F.struct(*rows.columns))) if key is None else key)
        for c in ("instance_id", "frames"):
            if c not in rows.columns:
                own = own.withColumn(c, F.lit(None).cast("string"))
        if self.where is not None:
            own = own.where(self.where())
        return own.select(*(F.col(k) for k in keep), *(c.alias(n) for n, c in self.columns().items()))


VIEWS: dict[str, View] = {}


def _view(name: str, scan: str, schema: str, columns: Callable[[], dict[str, Column]], where: Callable[[], Column] | None = None, field: str | None = None) -> None:
    if name in VIEWS:
        raise KeyError(name)
    VIEWS[name] = View(name, scan, schema, columns, where, field)


def c(name: str) -> Column:
    return F.col(name)


def ask(pool, value: Column | None = None, around: str = X.IMAGE + " {} ") -> Column:
    return X.instruction(pool if isinstance(pool, tuple) else (pool,), c("_key"), value, around)


def clean(text: Column) -> Column:
    return T.caption_clean(text)


def any_of(values: Column, salt: str = "") -> Column:
    """One element by the row's hash; of repeated answers, the more frequent the likelier."""
    place = F.conv(F.substring(F.md5(F.concat(c("_key"), F.lit(salt))), 1, 8), 16, 10).cast("long") % F.greatest(F.size(values), F.lit(1))
    return F.get(values, place.cast("int"))


def last_part(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def jpg(stem: Column) -> Column:
    return F.concat(stem, F.lit(".jpg"))


def prompted(question: Column) -> Column:
    """Image places (with what is said between them, where the rows bring it as ``frames``), then the question."""
    return F.concat(F.coalesce(c("frames"), F.lit("<Img><ImageHere>" * 45)), F.lit("\n"), question)


def short(question: Column) -> Column:
    return F.concat(F.lit("[vqa] Based on the image, respond to this question with a short answer: "), question)


def relative_boxes(boxes: Column, lead: str = "") -> Column:
    """Boxes x, y, width, height as <x1><y1><x2><y2>, the far corner from the cut width."""
    one = lambda b: F.regexp_replace(N.box_text(*N.grid_box(F.get(b, 0), F.get(b, 1), F.get(b, 2), F.get(b, 3))), "[{}]", "")
    return F.transform(boxes, lambda b: F.concat(F.lit(lead), one(b)))


def chunk_parts(chunks: Column) -> tuple[Column, Column]:
    """(phrases, boxes) of chunks (start, end, x1, y1, x2, y2) of the caption."""
    at = lambda x, i: F.get(x, i)
    grid = lambda x, i: (at(x, i) * 100).cast("int")
    phrases = F.transform(chunks, lambda x: F.substring(c("caption"), at(x, 0).cast("int") + 1, (at(x, 1) - at(x, 0)).cast("int")))
    return phrases, F.transform(chunks, lambda x: N.box_text(grid(x, 2), grid(x, 3), grid(x, 4), grid(x, 5)))


def _drawn_pair(left: Column, right: Column) -> tuple[Column, Column]:
    return any_of(left, "pair"), any_of(right, "pair")


def _asked(image: Column, question: Column, answer: Column, **more: Column) -> dict[str, Column]:
    return {"image": image, "instruction_input": question, "answer": answer, **more}


# questions about images
_view("AOKVQADataset", "annotations", _AOK, lambda: _asked(last_part(c("image")), ask(VQA, clean(clean(c("question")))), clean(any_of(c("direct_answers")))))
_view("AOKVQGDataset", "annotations", _AOK, lambda: _asked(last_part(c("image")), ask(QUESTION_FOR, any_of(c("direct_answers")), "{}"), clean(c("question"))))
_view("AOKVQAReasoningDataset", "lines", "image_path:string,question:string,analysis:string", lambda: _asked(last_part(c("image_path")), ask("[vqa] {}", clean(clean(c("question")))), X.rationale_parts(c("analysis"))[1], analysis=X.rationale_parts(c("analysis"))[0]))
_view("AOKVQGReasoningDataset", "lines", "image_path:string,question:string,analysis:string", lambda: _asked(last_part(c("image_path")), ask(QUESTION_FOR, X.rationale_parts(c("analysis"))[1], "{}"), clean(c("question"))))
_view("COCOVQADataset", "annotations", _QA, lambda: _asked(last_part(c("image")), ask(VQA, clean(c("question"))), clean(any_of(c("answer"))), question_id=c("question_id")))
_view("COCOVQGDataset", "annotations", _QA, lambda: _asked(last_part(c("image")), ask(QUESTION_FOR, any_of(c("answer")), X.IMAGE + " {}"), clean(c("question")), question_id=c("question_id")))
_view("COCOVQAEvalDataset", "annotations", _QA, lambda: {"image": c("image"), "image_path": c("image"), "question": clean(c("question")), "question_id": c("question_id"), "instruction_input": ask("Question: {} Short answer:", clean(c("question"))), "instance_id": c("instance_id")})
_view("GQADataset", "annotations", "image:string,question:string,question_id:string,answer:string", lambda: _asked(c("image"), ask(VQA, clean(c("question"))), clean(c("answer"))))
_view("GQAEvalDataset", "annotations", "image:string,question:string,question_id:string,answer:string", lambda: {"image": c("image"), "text_input": clean(c("question")), "answer": c("answer"), "image_path": c("image"), "instruction_input": ask(SHORT_ANSWER, clean(c("question"))), "question_id": c("question_id"), "instance_id": c("instance_id")})
_view("GroundedCaptionReasonDataset", "annotations", _QA, lambda: _asked(last_part(c("image")), ask("[vqa] {}", clean(c("question")), X.IMAGE + " {}"), any_of(c("answer")), question_id=c("question_id")))
_view("CaptionReasonDataset", "annotations", _QA + ",grounded_caption:string,detailed_caption:string", lambda: _asked(last_part(c("image")), ask("[reasoning] {}", clean(c("question")), X.IMAGE + " {}"), F.concat(c("grounded_caption"), F.lit(" short answer: "), any_of(c("answer"))), question_id=c("question_id")))
_view("ReasoningDataset", "annotations", "image_id:string,question:string,answer:string", lambda: _asked(jpg(c("image_id")), ask("{}", c("question")), c("answer")))
_view("VQADataset", "annotations", _QA, lambda: {"image": c("image"), "question": c("question"), "question_id": c("question_id"), "answer": any_of(c("answer")), "instance_id": c("instance_id")})
_view("VQAEvalDataset", "annotations", _QA, lambda: {"image": c("image"), "question": c("question"), "question_id": c("question_id"), "instance_id": c("instance_id")})
_view("textVQAEvalDataset", "table", "image:string,question:string,question_id:string,answers:array<string>", lambda: {"image": c("image"), "text_input": clean(c("question")), "answer": F.array_join("answers", "_"), "instruction_input": ask(SHORT_ANSWER, clean(c("question"))), "question_id": c("question_id"), "instance_id": c("instance_id")})
_view("SingleSlideVQADataset", "lines", "qa_id:string,question:string,answer:string,deck_name:string,evidence_pages:array<int>", lambda: _asked(F.concat(c("deck_name"), F.lit("/"), X.page_file(F.get("evidence_pages", 0))), ask(SLIDE, clean(c("question")), "{}"), c("answer"), qa_id=c("qa_id")), lambda: F.size("evidence_pages") == 1)
_OCR = "key:string,imageURL:string,split:int,questions:array<string>,answers:array<string>,title:string,genre:string"
_view("OCRVQADataset", "keyed_pairs", _OCR.replace("key:string,", ""), lambda: _asked(F.concat(c("key"), F.regexp_extract("imageURL", r"(\.[^./]*)$", 1)), ask("Q: {} A: ", clean(c("qa.q"))), clean(c("qa.a")), image_id=c("key")), lambda: c("split") == 1)
_view("TextOCRDataset", "keyed", "image_id:string,bbox:array<double>,utf8_string:string,width:int,height:int", lambda: _asked(jpg(c("image_id")), ask("[OCR] {}", F.get(relative_boxes(F.array(F.array(F.get("bbox", 0) / c("width"), F.get("bbox", 1) / c("height"), F.get("bbox", 2) / c("width"), F.get("bbox", 3) / c("height"))), " "), 0), X.IMAGE + " {}"), c("utf8_string"), image_id=c("key")), field="anns")
_view("PlotVQADataset", "enveloped", "image_index:string,question_string:string,answer:string", lambda: _asked(F.concat(c("image_index"), F.lit(".png")), F.concat(F.lit("Q: "), F.lit(X.IMAGE + " "), c("question_string"), F.lit("  A:")), c("answer"), image_id=c("image_index")), field="qa_pairs")

# captions
_COCO = "image:string,image_id:string,caption:string"
_view("CaptionDataset", "annotations", _COCO, lambda: {"image": X.image_file(c("image_id")), "answer": clean(c("caption")), "image_id": c("image_id")})
_view("COCOCaptionDataset", "annotations", _COCO, lambda: {"image": last_part(c("image")), "answer": clean(c("caption")), "instruction_input": ask(tuple("[caption] " + p for p in CAPTION))}, lambda: c("image").contains("train"))
_view("CaptionEvalDataset", "annotations", _COCO, lambda: {"image": c("image"), "image_id": c("image_id"), "instance_id": c("instance_id")})
_view("COCOCapEvalDataset", "annotations", _COCO, lambda: {"image": c("image"), "image_id": F.element_at(F.split(F.btrim(last_part(c("image")), F.lit(".jpg")), "_"), -1), "instance_id": c("instance_id")})
_view("NoCapsEvalDataset", "annotations", "image:string,img_id:string", lambda: {"image": c("image"), "image_id": c("img_id"), "instance_id": c("instance_id")})
_view("EvalCaptionData", "annotations", _COCO, lambda: {"image": last_part(c("image")), "question": F.lit("[caption] please describe this image?"), "image_id": c("image_id")})
_view("CCSBUAlignDataset", "annotations", _COCO, lambda: {"image": jpg(c("image_id")), "answer": c("caption"), "image_id": c("image_id")})
_view("CCSBUDataset", "shards", "caption:string", lambda: {"image": jpg(c("sample")), "answer": clean(c("caption"))})
_view("LaionDataset", "shards", "caption:string", lambda: _asked(jpg(c("sample")), ask(tuple("[caption] " + p for p in CAPTION)), clean(c("caption"))))
_view("TextCapDataset", "enveloped", "image_id:string,caption_str:string", lambda: _asked(jpg(c("image_id")), ask(tuple("[caption] " + p for p in CAPTION)), clean(c("caption_str")), data_type=F.lit("bbox"), question_split=F.lit("true")), field="data")
_view("LocNaCOCODataset", "lines", "image_id:string,caption:string", lambda: _asked(X.image_file(c("image_id")), ask(LONG_CAPTION, None, "###Human: {} ###Assistant: "), c("caption")), lambda: X.has_words(c("caption")))
_view("GroundedDetailDataset", "annotations", "image_id:string,grounded_caption:string", lambda: _asked(F.concat(F.lit("COCO_train2014_"), jpg(c("image_id"))), ask(DETAIL), c("grounded_caption"), image_id=c("image_id")))

# grounded phrases and boxes
_view("COYOCaptionWDSDataset", "shards", _CHUNKS, lambda: _asked(jpg(c("sample")), ask(GROUNDED), clean(X.grounded_caption(c("caption"), *chunk_parts(c("noun_chunks"))))))
_view("COYOBoxToPhraseWDSDataset", "shards", _CHUNKS, lambda: _asked(jpg(c("sample")), ask(IDENTIFY, any_of(chunk_parts(c("noun_chunks"))[1], "pair")), clean(any_of(chunk_parts(c("noun_chunks"))[0], "pair"))))
_view("COYOPhraseToBoxWDSDataset", "shards", _CHUNKS, lambda: _asked(jpg(c("sample")), ask(REFER, clean(any_of(chunk_parts(c("ref_exps"))[0], "pair"))), any_of(chunk_parts(c("ref_exps"))[1], "pair")))
for _set, _lead in (("LVISBBOXDataset", " "), ("OpenImageDataset", "")):
    _view(_set, "shards", _BOXED, lambda lead=_lead: _asked(jpg(c("sample")), F.concat(F.lit(X.IMAGE + " "), clean(F.lit(LIST_OBJECTS))), clean(X.object_list(c("objects"), relative_boxes(c("bbox"), lead), c("_key"))), data_type=F.lit("bbox"), question_split=F.lit("true")))
for _set in ("LVISBboxToObjectDataset", "OpenBboxToObjectDataset"):
    _view(_set, "shards", _BOXED, lambda: _asked(jpg(c("sample")), ask(OBJECT_AT, F.concat(F.lit("{"), any_of(relative_boxes(c("bbox")), "pair"), F.lit("}"))), clean(any_of(c("objects"), "pair")), data_type=F.lit("bbox"), question_split=F.lit("true")))
_WORDS = "image_id:string,caption_str:string,ocr_info:array<struct<word:string,bounding_box:struct<top_left_x:double,top_left_y:double,width:double,height:double>>>"


def _word_box() -> tuple[Column, Column]:
    word = any_of(X.valid_words(c("ocr_info")), "word")
    b = word["bounding_box"]
    return word["word"], N.box_text(*N.grid_box(b["top_left_x"], b["top_left_y"], b["width"], b["height"]))


_view("TextCapBboxToObjectDataset", "enveloped", _WORDS, lambda: _asked(jpg(c("image_id")), ask("[OCR] {}", _word_box()[1], X.IMAGE + " {}"), _word_box()[0], data_type=F.lit("bbox"), question_split=F.lit("true")), lambda: F.size(X.valid_words(c("ocr_info"))) > 0, field="data")
_view("ReferVisualGenomeDataset", "nested", "image_id:string,phrase:string,x:double,y:double,width:double,height:double,image_width:double,image_height:double", lambda: _asked(
    jpg(c("image_id")), ask(REFER, clean(c("phrase"))), N.box_text(*((v * 100).cast("int") for v in (c("x") / c("image_width"), c("y") / c("image_height"), (c("x") + c("width")) / c("image_width"), (c("y") + c("height")) / c("image_height")))), image_id=c("image_id")
), lambda: c("width") * c("height") < 16384)
_view("RefCOCOEvalData", "annotations", "img_id:string,sents:string", lambda: {"image": jpg(F.substring("img_id", 1, 27)), "question": F.concat(F.lit("[refer] where is "), c("sents"), F.lit("?")), "img_id": c("img_id")})

# conversations and plain instructions
for _set in ("LlavaDetailDataset", "LlavaReasonDataset"):
    _view(_set, "annotations", _TALK, lambda: _asked(
        F.concat(F.lit("COCO_train2014_"), jpg(c("id"))), ask("{}", clean(T.strip(F.replace(F.replace(F.get("conversations", 0)["value"], F.lit("<image>"), F.lit("")), F.lit("\n"), F.lit(""))))), F.get("conversations", 1)["value"], image_id=c("id")
    ))
_view("LlavaConversationDataset", "annotations", _TALK, lambda: dict(zip(("conv_q", "conv_a"), X.turns_folded(F.transform("conversations", lambda t: t["value"])), strict=True)) | {"image": F.concat(F.lit("COCO_train2014_"), jpg(c("id"))), "image_id": c("id"), "connect_sym": F.lit(X.TURN)})
_view("CoTDataset", "annotations", "inputs:string,targets:string", lambda: {"instruction_input": c("inputs"), "answer": c("targets")})
_view("UnnaturalDataset", "annotations", "instances:array<struct<instruction_with_input:string,constraints:string,output:string>>", lambda: {"instruction_input": X.constrained(F.get("instances", 0)["instruction_with_input"], F.get("instances", 0)["constraints"]), "answer": F.get("instances", 0)["output"]})
_view("NavR2RDataset", "folders", "instructions:array<string>,action:array<string>,n_steps:int", lambda: {
    "image": F.array_join(F.transform(F.sequence(F.lit(0), c("n_steps") - 2), lambda i: F.concat(c("data_id"), F.lit("/"), i.cast("string"), F.lit(".jpg"))), ","),
    "conv_q": F.concat(F.lit("Command: "), any_of(c("instructions")), F.lit("\n\n"), F.array_join(F.transform("action", lambda _: F.lit("<ImageHere> A: ")), X.TURN)), "conv_a": F.array_join("action", X.TURN), "connect_sym": F.lit(X.TURN), "data_id": c("data_id"),
}, lambda: c("n_steps") > 1)

# strokes and masks; what is measured in pixels comes as columns
_STROKES = "image_id:string,strokes:array<array<double>>,tag:string"
_view("PaintPTCOCODataset", "table", "image_id:string,stroke:array<double>", lambda: _asked(jpg(c("image_id")), F.lit("<Image><ImageHere><Canvas><ImageHere> Next Stroke: "), X.point_stroke(c("stroke")), image_id=c("image_id"), length=F.lit("2")))
_view("PaintRLCOCODataset", "table", _STROKES, lambda: _asked(jpg(c("image_id")), F.lit("<Image><ImageHere><Canvas><ImageHere> Action: "), X.stroke_text(c("strokes"), c("tag")), image_id=c("image_id"), length=F.lit("2")))
_view("PaintLanRLOpaqueCOCODataset", "table", _STROKES + ",captions:array<string>", lambda: _asked(jpg(c("image_id")), F.concat(F.lit("Task: "), any_of(c("captions")), F.lit("\nCanvas: <ImageHere> Action: ")), X.stroke_text(c("strokes"), c("tag"), opaque=True), image_id=c("image_id")))
_view("PaintPixelCOCODataset", "table", "image:string,image_id:string,loc_y:int,loc_x:int,rgb:array<int>", lambda: _asked(last_part(c("image")), F.concat(F.lit(X.IMAGE + " [reconstruct] loc: ["), c("loc_y"), F.lit(","), c("loc_x"), F.lit("] rgb: ")), F.concat(F.lit("["), F.array_join("rgb", ","), F.lit("]"))), lambda: c("image").contains("train"))
_view("SegReferCOCODataset", "table", "file_name:string,split:string,refers:array<string>,loc_y:int,loc_x:int,mask:int", lambda: _asked(c("file_name"), F.concat(F.lit(X.IMAGE + " [segmentation] "), any_of(c("refers")), F.lit(" loc: ["), c("loc_y"), F.lit(","), c("loc_x"), F.lit("] mask: ")), c("mask").cast("string")), lambda: c("split") == "train")


# videos; ``frames`` brings the image places with what is said between them (operators.subtitles.frame_captions)
def _video(question: Column, answer: Column, video: Column) -> dict[str, Column]:
    return {"image": F.concat(video, F.lit(".mp4")), "answer": answer, "image_id": video, "instruction_input": prompted(question), "length": F.lit("45")}


_view("CMDVideoDataset", "annotations", "image_id:string,caption:string", lambda: _video(ask(VIDEO, None, "{}"), c("caption"), c("image_id")))
_view("WebVidDataset", "annotations", "videoid:string,name:string,page_dir:string", lambda: _video(ask(VIDEO, None, "{}"), X.video_caption(c("name")), c("videoid")) | {"image": F.concat_ws("/", "page_dir", F.concat(c("videoid"), F.lit(".mp4")))})
_view("VideoChatGPTDataset", "annotations", _VIDEO, lambda: _video(c("q"), c("a"), c("video_id")))
_view("VideoChatGPTEvalDataset", "annotations", _VIDEO, lambda: _video(c("q"), c("a"), c("video_id")))
_view("Video_validation_Dataset", "annotations", _VIDEO, lambda: _video(c("q"), c("a"), c("video_id")))
_view("VideoChatGPTEval_consistancy", "annotations", "video_id:string,q1:string,q2:string,a:string", lambda: _video(c("q1"), c("a"), c("video_id")) | {"instruction_2": prompted(c("q2"))})
_view("TVQAEVAL", "annotations", "vid_name:string,show_name:string,q:string,a0:string,a1:string,a2:string,a3:string,a4:string,answer_idx:string", lambda: _video(X.numbered_choice_prompt(c("q"), [c(f"a{i}") for i in range(5)]), c("answer_idx"), c("vid_name")) | {
    "image": F.concat_ws("/", F.try_element_at(F.create_map(*(F.lit(x) for kv in SHOW_FOLDERS.items() for x in kv)), c("show_name")), "vid_name")
})
_view("Video_loader_template", "annotations", _VIDEO, lambda: _video(c("q"), c("a"), c("video_id")) | {"image": F.concat(F.lit("videos/"), c("video_id"), F.lit(".mp4"))})

# evaluation questions
_view("OKVQAEvalData", "annotations", "image_id:string,question:string,question_id:string", lambda: {"image": X.image_file(c("image_id")), "question": short(c("question")), "question_id": c("question_id"), "img_id": c("image_id")})
_view("VizWizEvalData", "annotations", "image:string,question:string,answers:array<struct<answer:string>>", lambda: {"image": c("image"), "question": F.concat(short(c("question")), F.lit(" and reply 'unanswerable' if you could not answer it")), "answers": F.array_join(F.transform("answers", lambda a: a["answer"]), "_")})
_view("AOKVQADAEvalData", "annotations", _AOK, lambda: {"image": c("image"), "question": short(c("question")), "question_id": c("question_id")})
_view("AOKVQAMCEvalData", "annotations", _AOK, lambda: {"image": c("image"), "question": short(c("question")), "question_id": c("question_id"), "candidates": F.array_join("choices", "_")})
_view("IconQAEvalData", "annotations", "image_id:string,question:string,choices:array<string>,answer:string", lambda: {"image": F.concat(c("image_id"), F.lit("/image.png")), "question": short(c("question")), "candidates": F.array_join("choices", "_"), "answer": c("answer")})
_view("GQAEvalData", "annotations", "image:string,question:string,answer:string", lambda: {"image": c("image"), "question": short(c("question")), "labels": c("answer")})
_view("HMEvalData", "annotations", "img:string,text:string,label:string", lambda: {"image": c("img"), "question": F.concat(F.lit('[vqa] This is an image with: "'), c("text"), F.lit('" written on it. Is it hateful? Answer:')), "labels": c("label")})
_view("VSREvalData", "annotations", "image:string,caption:string,label:int", lambda: {"image": c("image"), "question": F.concat(F.lit("[vqa] Based on the image, is this statement true or false? "), c("caption")), "labels": F.when(c("label") == 1, "true").otherwise("false")})


def rows_of(spark: SparkSession, view: View, path: str) -> DataFrame:
    """The annotation rows of a view's files."""
    if view.scan == "annotations":
        return S.annotations(spark, path, view.schema)
    if view.scan == "lines":
        return S.lines(spark, path, view.schema)
    if view.scan == "enveloped":
        return S.enveloped(spark, path, view.field, view.schema)
    if view.scan == "keyed":
        return S.keyed(spark, path, view.schema, view.field)
    if view.scan == "keyed_pairs":
        return question_pairs(S.keyed(spark, path, view.schema))
    if view.scan == "shards":
        return S.shards(spark, path, view.schema)
    if view.scan == "folders":
        return S.folders(spark, path, view.schema)
    if view.scan == "nested":
        return S.nested(spark, path, view.schema)
    return spark.read.parquet(path)


def question_pairs(rows: DataFrame) -> DataFrame:
    """A row for each question of (questions, answers), as ``qa``."""
    return rows.withColumn("qa", F.explode(F.arrays_zip(F.col("questions").alias("q"), F.col("answers").alias("a"))))


def open_view(spark: SparkSession, name: str, path: str, frames: DataFrame | None = None) -> DataFrame:
    """The samples of a reader's files; ``frames`` (video_id, frames) gives videos what is said between their frames."""
    view = VIEWS[name]
    rows = rows_of(spark, view, path)
    if frames is not None:
        key = next(k for k in ("video_id", "vid_name", "videoid", "image_id") if k in rows.columns)
        rows = rows.join(frames.select(F.col("video_id").alias(key), "frames"), key, "left")
    return view.over(rows)


# The names under which datasets are registered, the reader of each, and its settings' file. "-" stands for no name.
BUILDERS = [
    ("yifan_reasoning", "AOKVQAReasoningDataset", "aokvqa_reasoning/defaults.yaml"), ("caption_reasoning", "CaptionReasonDataset", "mm_reasoning/mm_reasoning.yaml"), ("unnatural_instruction", "UnnaturalDataset", "nlp/unnatural_instruction.yaml"),
    ("cot", "CoTDataset", "nlp/cot.yaml"), ("coco_caption", "COCOCaptionDataset", "coco/caption.yaml"), ("open_images", "OpenImageDataset", "open_images/default.yaml"), ("open_images_bbox_to_object", "OpenBboxToObjectDataset", "open_images/default_bbox.yaml"),
    ("lvis_images_bbox", "LVISBBOXDataset", "lvis/default_bbox.yaml"), ("lvis_bbox_to_object", "LVISBboxToObjectDataset", "lvis/bbox_to_object.yaml"), ("spatial_reasoning", "ReasoningDataset", "reasoning/default.yaml"), ("textcaps_caption", "TextCapDataset", "textcaps/caption.yaml"),
    ("coyo_caption", "COYOCaptionWDSDataset", "coyo/default.yaml"), ("coyo_bbox_phrase", "COYOBoxToPhraseWDSDataset", "coyo/bbox_phrase.yaml"), ("coyo_phrase_bbox", "COYOPhraseToBoxWDSDataset", "coyo/phrase_bbox.yaml"), ("cc_sbu_align", "CCSBUAlignDataset", "cc_sbu/align.yaml"),
    ("cc_sbu", "CCSBUDataset", "cc_sbu/defaults.yaml"), ("textcaps_ocr", "TextCapBboxToObjectDataset", "textcaps/ocr.yaml"), ("laion", "LaionDataset", "laion/defaults.yaml"), ("locna_coco", "LocNaCOCODataset", "coco/defaults_locna.yaml"), ("llava_detail", "LlavaDetailDataset", "llava/detail.yaml"),
    ("grounded_detailed_image_caption", "GroundedDetailDataset", "grounded_image_caption/default.yaml"), ("llava_reason", "LlavaReasonDataset", "llava/reason.yaml"), ("llava_conversation", "LlavaConversationDataset", "llava/conversation.yaml"), ("-refcoco", "RefCOCOEvalData", ""),
    ("refvg", "ReferVisualGenomeDataset", "vg/ref.yaml"), ("cmd_video", "CMDVideoDataset", "cmd_video/default.yaml"), ("webvid", "WebVidDataset", "webvid/default.yaml"), ("video_chatgpt", "VideoChatGPTDataset", "video_chatgpt/default.yaml"), ("Name of the builder as in the config file", "Video_loader_template", "path to the config file"),
    ("r2r", "NavR2RDataset", "nav/r2r.yaml"), ("paintcoco", "PaintPTCOCODataset", "paint/coco.yaml"), ("-paintrl", "PaintRLCOCODataset", ""), ("paintrlcoco", "PaintRLCOCODataset", "paint/rl_coco.yaml"), ("paintrlscoco", "PaintRLCOCODataset", "paint/rls_coco.yaml"),
    ("paintlanrlsococo", "PaintLanRLOpaqueCOCODataset", "paint/lan_rls_o_coco.yaml"), ("-paintpixel", "PaintPixelCOCODataset", ""), ("paintpixelcoco32", "PaintPixelCOCODataset", "paint/pixel_coco_32.yaml"), ("paintpixelcoco64", "PaintPixelCOCODataset", "paint/pixel_coco_64.yaml"),
    ("-segrefcoco", "SegReferCOCODataset", ""), ("segrefcoco32", "SegReferCOCODataset", "paint/segrefcoco32.yaml"), ("segrefcocop32", "SegReferCOCODataset", "paint/segrefcocop32.yaml"), ("segrefcocog32", "SegReferCOCODataset", "paint/segrefcocog32.yaml"),
    ("segrefcoco64", "SegReferCOCODataset", "paint/segrefcoco64.yaml"), ("segrefcocop64", "SegReferCOCODataset", "paint/segrefcocop64.yaml"), ("segrefcocog64", "SegReferCOCODataset", "paint/segrefcocog64.yaml"), ("coco_vqa", "COCOVQADataset", "coco/defaults_vqa.yaml"), ("ok_vqa", "COCOVQADataset", "okvqa/defaults.yaml"),
    ("aok_vqa", "AOKVQADataset", "aokvqa/defaults.yaml"), ("aok_vqa_reasoning", "AOKVQAReasoningDataset", "aokvqa_reasoning/defaults.yaml"), ("gqa", "GQADataset", "gqa/balanced_val.yaml"), ("coco_vqg", "COCOVQGDataset", "coco/defaults_vqg.yaml"), ("ok_vqg", "COCOVQGDataset", "okvqa/defaults_vqg.yaml"),
    ("-documents", "PlotVQADataset", ""), ("sslidevqa", "SingleSlideVQADataset", "doc/sslidevqa.yaml"), ("ocrvqa", "OCRVQADataset", "doc/ocrvqa.yaml"),
]


def build(spark: SparkSession, name: str, paths: dict[str, str], frames: DataFrame | None = None) -> DataFrame:
    """The samples of a registered dataset, with ``dataset`` and ``split``; paths has a place for each split, and train may be several sets."""
    reader = dict((n, r) for n, r, _ in BUILDERS)[name]
    out = None
    for split, path in paths.items():
        one = open_view(spark, reader, path, frames).withColumn("dataset", F.lit(name)).withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one)
    return out
