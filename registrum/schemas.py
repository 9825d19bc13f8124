"""Record layouts and the closed label vocabularies."""

# The four facets and the labels each may take.
MEDIUM = ["written", "transcribed", "cannot_rate"]
TURN = ["monologic", "dialogic"]
ACTIVITY = ["recounting", "explaining", "directing", "evaluating", "promoting", "creating"]
FORMALITY = ["formal", "informal"]

FACET_VALUES = {
    "mode_medium": MEDIUM,
    "mode_turn": TURN,
    "field_activity": ACTIVITY,
    "tenor_formality": FORMALITY,
}
FACETS = list(FACET_VALUES)
SECTIONS = ["main", "comments"]

LINE = "struct<num:int,text:string>"
FACET_FIELDS = "mode_medium:string,mode_turn:string,field_activity:string,tenor_formality:string"
LABELS = f"struct<{FACET_FIELDS}>"
ANNOTATION = f"struct<line:int,{FACET_FIELDS},is_structural:boolean>"
ANNOTATIONS = f"array<{ANNOTATION}>"
SECTION_PAIR = f"struct<main:{ANNOTATIONS},comments:{ANNOTATIONS}>"
SEGMENT = "struct<label:string,text:string>"

TOKEN = (
    "struct<id:int,text:string,lemma:string,upos:string,xpos:string,"
    "feats:string,head:int,deprel:string,start_char:int,end_char:int>"
)
SENTENCE = f"struct<text:string,tokens:array<{TOKEN}>>"
PARSE = f"struct<sentences:array<{SENTENCE}>>"
PARSED_SEGMENT = f"struct<label:string,text:string,parse:{PARSE},_source:string>"

RAW_DOCUMENT = "xml string, u string"
SIMPLIFIED_DOCUMENT = f"{RAW_DOCUMENT}, xml_simplified string, markdown_main string, markdown_comments string"
ANNOTATED_DOCUMENT = (
    f"{SIMPLIFIED_DOCUMENT}, llm_register_annotation {SECTION_PAIR}, classification_failed boolean"
)
TASK = (
    "struct<task_id:bigint,doc_idx:bigint,section:string,url:string,line_idx:int,line_num:int,line_text:string,"
    f"context_before:array<{LINE}>,context_after:array<{LINE}>,llm:{LABELS}>"
)
SESSION = (
    "annotator string, timestamp string, total_tasks bigint, "
    "scheme struct<mode_medium:array<string>,mode_turn:array<string>,"
    "field_activity:array<string>,tenor_formality:array<string>>, "
    "agreement struct<ag:bigint,dis:bigint,tot:bigint>, "
    "annotations array<struct<task_id:bigint,doc_idx:bigint,section:string,url:string,line_num:int,"
    f"line_text:string,context_before:array<{LINE}>,context_after:array<{LINE}>,"
    f"llm_labels:{LABELS},human_labels:{LABELS}>>"
)

FEATURE_META = ["doc_id", "source", "segment_idx", "label", "n_tokens", "n_sents"]
STRUCTURAL_FEATURES = ["mean_sent_len", "mean_dep_dist", "mean_word_len", "mattr50_words", "mattr50_lemmas"]
