"""Explicit schemas of the domain tables."""

from __future__ import annotations

PROJECTS = "id string, path string, label string, git_id string, default_branch string, remote string, alt_remotes string, local_user string, local_email string, old_paths string, git_worktree_paths string, ignored boolean, ignore_diff_paths string, ignore_default_diff_paths boolean"
CONVERSATIONS = "id string, project_id string, agent string, title string, model string, started_at long, ended_at long, parent_conversation_id string, family_root_id string, hidden boolean, user_prompt_count int, files_edited string, url string"
MESSAGES = "id string, timestamp long, project_id string, conversation_id string, role string, message_type string, model string, content string, raw_json string"
RATINGS = "id string, conversation_id string, temp_conversation_id string, rating int, note string, analysis string, created_at long, seq long"
COMMITS = "id string, project_id string, branch_name string, commit_hash string, subject string, user_name string, user_email string, authored_at long, diff_content string, lines_total long, lines_from_agent long, lines_added long, lines_removed long, coverage_version int, override_agent_percents string, needs_parent boolean, ignored boolean"
COVERAGE = "commit_id string, agent string, lines_from_agent long"
LINKS = "commit_id string, conversation_id string"
SCAN_STATE = "agent string, source_kind string, source_key string, file_size long, file_mtime_ms long, file_offset long, state_json string, updated_at_ms long"
FILES = "array<struct<path:string,added:long,removed:long,ignored:boolean,moved:boolean,linesTotal:long,linesFromAgent:long,agentSegments:array<struct<agent:string,linesFromAgent:double>>>>"
