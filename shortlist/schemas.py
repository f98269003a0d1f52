"""Column layouts shared by readers, operators and tests."""

REQUIREMENT_STRUCT = (
    "struct<id:string,text:string,type:string,weight:int,isRequired:boolean,"
    "keywords:array<string>,synonyms:array<string>>"
)
REQUIREMENT_ROW = (
    "job_position_id string, req_pos int, requirement_id string, text string, type string, "
    "weight int, is_required boolean, keywords array<string>, synonyms array<string>"
)
SECTIONS_STRUCT = (
    "struct<experience:string,skills:string,education:string,summary:string,other:string>"
)
ENTITIES_STRUCT = (
    "struct<years_of_experience:int,technologies:array<string>,degrees:array<string>,"
    "companies:array<string>,roles:array<string>>"
)
AI_SCORE_STRUCT = "struct<requirementId:string,score:double,reasoning:string,evidence:string>"
AI_RESPONSE_STRUCT = f"struct<scores:array<{AI_SCORE_STRUCT}>,overallSummary:string>"
KEYWORD_SCORES_MAP = "map<string,struct<matched_sentences:array<string>,raw_score:double>>"
CV_ROW = (
    f"cv_id bigint, job_position_id string, original_filename string, mime_type string, "
    f"raw_text string, anonymized_text string, sections {SECTIONS_STRUCT}, "
    f"sentences array<string>, entities {ENTITIES_STRUCT}, parsing_confidence string, "
    f"keyword_scores {KEYWORD_SCORES_MAP}, ai_scores {AI_RESPONSE_STRUCT}, final_score double, "
    f"tier string, elimination_reason string, ai_model_used string, ai_cost_usd double, "
    f"created_at timestamp_ntz"
)
JOB_ROW = (
    f"job_position_id string, user_id string, title string, job_description_text string, "
    f"requirements array<{REQUIREMENT_STRUCT}>, status string, total_cvs int, processed_cvs int, "
    f"great_match_count int, good_match_count int, no_match_count int, ai_cost_usd double, "
    f"current_stage string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
PROGRESS_EVENT_ROW = (
    "job_position_id string, seq bigint, ts timestamp, stage string, processed int, total int"
)
OP_EVENT_ROW = "job_position_id string, op string, phase string, ts timestamp, seq bigint"
TEXT_ITEM_ROW = (
    "doc_id bigint, page int, idx int, str string, y double, height double, has_eol boolean"
)
GENERATED_CV_STRUCT = (
    "struct<name:string,email:string,yearsExperience:double,summary:string,"
    "experience:array<struct<company:string,role:string,startYear:int,endYear:int,"
    "bullets:array<string>>>,skills:array<string>,education:string>"
)
