"""Pieces of SQL that several queries share."""

SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapse(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{SPACE}+', ' ', 'g'))"


def words(c: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+')"


def unit(key: str, seed: int) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || {key}), 1, 15))::bigint)::double / 1152921504606846976.0"


def split_norm(c: str) -> str:
    s = f"lower({c})"
    return f"case {s} when 'validation' then 'val' when 'valid' then 'val' when 'dev' then 'val' when 'training' then 'train' when 'testing' then 'test' else {s} end"


_FIELDS = {"id": "id", "split": "split", "task_family": "task_family", "difficulty": "difficulty", "system": "system_text", "user": "user_text", "assistant": "assistant_text", "answer_format": "answer_format", "eval_type": "eval_type", "metadata_json": "metadata_json"}
#: with clause: conversation rows
CONV = "conv as (select row_id as line, " + ", ".join(f'{strip(v)} as "{k}"' for k, v in _FIELDS.items()) + " from chat_examples)"
_META = "metadata_json = '' or coalesce(case when json_valid(metadata_json) then json_type(metadata_json) end, '') = 'OBJECT'"
#: with clauses: rows with their reasons, and the accepted ones
REASONS = (
    CONV
    + ", ids as (select id, min(line) as first_line from conv where id <> '' group by id), marked as (select conv.*, list_filter(["
    + "case when \"user\" = '' then 'empty_user' end, case when assistant = '' then 'empty_assistant' end, "
    + "case when greatest(length(system), length(\"user\"), length(assistant)) > 1000000 then 'oversized_field' end, "
    + f"case when not ({_META}) then 'invalid_metadata_json' end, case when line > first_line then 'duplicate_id' end], lambda x: x is not null) as reasons from conv left join ids using (id)), "
    + "good as (select * exclude (reasons) from marked where len(reasons) = 0)"
)
HASH = f"sha256('{{\"assistant\":' || to_json({collapse('assistant')}) || ',\"system\":' || to_json({collapse('system')}) || ',\"user\":' || to_json({collapse('\"user\"')}) || '}}')"
_GROUP = "coalesce(" + ", ".join(
    # strings and whole numbers as they are written, true and false as True and False; nothing else
    f"case when json_type(metadata_json, '$.{k}') in ('VARCHAR', 'BIGINT', 'UBIGINT', 'BOOLEAN') and {strip(f"json_extract_string(metadata_json, '$.{k}')")} <> '' then 'metadata:{k}:' || case when json_type(metadata_json, '$.{k}') = 'BOOLEAN' then case json_extract_string(metadata_json, '$.{k}') when 'true' then 'True' else 'False' end else json_extract_string(metadata_json, '$.{k}') end end"
    for k in ("group_id", "conversation_id", "source_id", "parent_id")
) + ", case when id <> '' then 'id:' || id end, 'content:' || content_hash)"
#: with clauses: accepted rows with content_hash, group_key and assigned_split
SPLIT = (
    REASONS
    + f", hashed as (select *, {HASH} as content_hash from (select * replace (nullif(metadata_json, '') as metadata_json) from good)), keyed as (select *, {_GROUP} as group_key from hashed), "
    + f"placed as (select *, case when u < 0.9 then 'train' when u < 0.9 + 0.05 then 'val' else 'test' end as assigned_split from (select *, {unit('group_key', 1337)} as u from keyed))"
)
TEXT = "system || chr(10) || \"user\" || chr(10) || assistant"
FINGERPRINT = f"array_to_string({words(TEXT)}, ' ')"
