"""Schemas of the relations, never inferred."""

CHUNK = "chunk_id bigint, source_story string, paragraph_index int, content string, word_count int"
LABELED_CHUNK = f"{CHUNK}, label string, justification string, model string, prompt_version string, cached boolean"
CACHE = "key string, answer string"
EXAMPLE = "chunk_id bigint, source_story string, original_label string, framing string, word_count int, text string"
PROBE = "id int, category string, prompt string, expected_direction string"
QUESTION = "subject string, pos int, question string, choices array<string>, answer int"
AGENT = "struct<model_id: string, adapter_id: string, role: string, ground_truth_is_llm: boolean>"
TURN = "conv_id string, turn_idx int, speaker_id string, speaker_role string, model_id string, adapter_id string, prompt_tokens int, gen_tokens int, latency_ms double, ground_truth_is_llm boolean, reply string, suspicion_score double, reasoning_trace string, cues array<string>, trap_strategy struct<plan: string, type: string>, public_accusation boolean"
CONVERSATION = f"conv_id string, agent_A_cfg {
    AGENT
}, agent_B_cfg {AGENT}, n_turns int, winner string, termination_reason string, A_correct boolean, B_correct boolean, t_private_07 int, t_public int, commitment_gap int, seed int"
