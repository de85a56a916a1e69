"""Schemas of the stored tables and messages."""

from __future__ import annotations

# Embeddings keep the dimension of the model that made them; nothing here fixes it.
USER_PROFILES = "user_id long, display_name string, voice_credits int, created_ms long"
DOCUMENTS = (
    "id long, user_id long, filename string, object_key string, status string, chunk_count long, created_ms long, "
    "skipped_pages array<struct<page_number:long,reason:string,char_count:long>>"
)
PAGES = "document_id long, user_id long, filename string, page_number long, text string, has_images boolean"
CHUNKS = (
    "id string, document_id long, user_id long, filename string, content string, page_number long, "
    "page_number_end long, pages array<long>, heading string, section_id string, content_type string, "
    "chunk_index long, char_count long, terms array<string>, embedding array<float>"
)
CONVERSATIONS = (
    "id long, user_id long, title string, document_id long, summary string, created_ms long, updated_ms long"
)
CONVERSATION_DOCUMENTS = "conversation_id long, document_id long, added_ms long"
EVIDENCE = (
    "array<struct<id:string,document_id:long,content:string,page_number:long,filename:string,section:string,"
    "rrf_score:double>>"
)
MESSAGES = (
    "id long, conversation_id long, user_id long, role string, content string, voice_url string, "
    f"voice_urls array<string>, voice_used boolean, retrieved_chunks {EVIDENCE}, created_ms long"
)
SUMMARIES = (
    "id long, user_id long, source_type string, conversation_id long, document_id long, content string, created_ms long"
)
FLASHCARD_DECKS = (
    "id long, user_id long, source_type string, conversation_id long, document_id long, title string, created_ms long"
)
FLASHCARDS = "id long, deck_id long, question string, answer string, created_ms long"

UPLOAD_EVENT = "Message string, Records array<struct<s3:struct<bucket:struct<name:string>,object:struct<key:string>>>>"
EMBED_MESSAGE = (
    "message_type string, document_id string, chunk_ids array<string>, batch_num long, user_id string"
)
QUERY_JOB = (
    "job_id string, query string, user_id string, conversation_id string, voice_mode boolean, "
    "response_style string, document_ids array<string>"
)
GENERATION_TASK = "job_id string, user_id string, task_type string, conversation_id string, document_id string"
