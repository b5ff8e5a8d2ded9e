"""Row types as StructTypes; what other tools keep in a bag of metadata is a column here."""

from pyspark.sql import types as T

S, I, D, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _t(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


BLOCK = _t(type=S, text=S, left=T.LongType(), top=T.LongType(), width=T.LongType(), height=T.LongType())
PAGE_META = _t(parser=S, source_name=S, width_points=D, height_points=D, rotation=I, image_count=I, speaker_notes=S, blocks=T.ArrayType(BLOCK))
PAGE = _t(document_id=S, page_number=I, text=S, title=S, metadata=PAGE_META)
CHUNK_META = _t(source_name=S, source_title=S, window=I, page_count=I, retrievable_page_count=I, truncated=B, text_retrieval_excluded=B)
CHUNK = _t(chunk_id=S, document_id=S, page_start=I, page_end=I, text=S, section=S, parent_id=S, level=S, child_ids=T.ArrayType(S),
    metadata=CHUNK_META)
RENDERED_PAGE = _t(document_id=S, page_number=I, image_path=S, source_path=S, width=I, height=I, sha256=S, requires_vision=B, role=S,
    visual_risk_score=D)
EXAMPLE = _t(id=S, query=S, document_id=S, relevant_pages=T.ArrayType(I), relevant_chunk_ids=T.ArrayType(S), question_type=S, split=S,
    annotation_status=S, answer_hint=S)
TRIPLET = _t(query=S, positive_chunk_id=S, negative_chunk_id=S, negative_rank=I, miner=S, difficulty=S)
REVIEWED = T.StructType([*TRIPLET.fields, *_t(review_id=S, review_decision=S, review_note=S).fields])
PAIR = _t(query=S, text=S, label=D)
RESULT = _t(query_id=S, chunk_id=S, score=D, rank=I)
QUESTION_TYPES = ("text", "formula", "table_chart", "visual_only", "cross_page")
SPLITS = ("train", "dev", "test")
STATUSES = ("candidate", "verified")
LEVELS = ("section", "page", "passage")

_FILES = T.ArrayType(_t(filename=S, url=S))
SOURCE = _t(source_id=S, course=S, homepage=S, license=S, license_url=S, redistribution=S, repository=S, pairing_note=S,
    pairs=T.ArrayType(_t(pair_id=S, topic=S, courseware=_FILES, review=_FILES)))
MANIFEST = _t(download_root=S, sources=T.ArrayType(SOURCE))
