"""Where each operator of the survey is: queries (all with SQL unless said), tests, or a plug-in.

`plug-in` marks what needs model weights or a renderer, which aren't here: the interface and a stand-in are tested.
"""

MAP = {
    "SRC-01": "plug-in test_file_sources test_page_counts", "SRC-02": "plug-in test_page_counts", "SRC-03": "page_range selected_pages", "SRC-04": "test_page_counts", "SRC-05": "test_pixels_and_files",
    "SRC-06": "test_image_is_one_page_of_its_size", "SRC-07": "test_image_is_one_page_of_its_size", "SRC-08": "source_dispatch", "SRC-09": "test_uploads", "SRC-10": "base64_roundtrip test_process_and_file_parse",
    "SRC-11": "annotate_errors test_annotate test_annotate_looks_local_images_up", "SRC-12": "test_folder_keeps_order_and_errors", "SRC-13": "test_file_sources", "SRC-14": "test_file_sources", "SRC-15": "test_outputs_are_written_and_cleaned",
    "SNK-01": "document_markdown output_paths test_outputs_are_written_and_cleaned", "SNK-02": "content_list output_paths test_outputs_are_written_and_cleaned", "SNK-03": "middle_json model_json output_paths", "SNK-04": "output_paths test_outputs_are_written_and_cleaned",
    "SNK-05": "figure_elements equation_elements test_crops_and_overlays", "SNK-06": "overlay_colors test_crops_and_overlays", "SNK-07": "detail_report", "SNK-08": "output_paths test_outputs_are_written_and_cleaned", "SNK-09": "page_summaries", "SNK-10": "file_payloads test_payload_parts_are_sent_only_when_wanted",
    "PRJ-01": "bbox_geometry", "PRJ-02": "bbox_normalized", "PRJ-03": "layout_category_profile", "PRJ-04": "layout_category_profile", "PRJ-05": "layout_category_profile", "PRJ-06": "layout_clip_filter", "PRJ-07": "bbox_roi",
    "PRJ-08": "page_elements", "PRJ-09": "page_elements", "PRJ-10": "test_rules_and_cells_of_a_drawn_table", "PRJ-11": "test_rules_and_cells_of_a_drawn_table", "PRJ-12": "quad_poly", "PRJ-13": "quad_poly model_json",
    "PRJ-14": "file_stats", "PRJ-15": "table_letterbox", "PRJ-16": "table_letterbox", "PRJ-17": "parse_options", "PRJ-18": "test_pixels_and_files",
    "FLT-01": "layout_category_profile", "FLT-02": "layout_page_images layout_large_image_filter test_one_pass_equals_the_steps", "FLT-03": "layout_clip_filter", "FLT-04": "layout_bucket_counts", "FLT-05": "layout_text_boxes", "FLT-06": "layout_bucket_counts",
    "FLT-07": "layout_unsupported_boxes", "FLT-08": "test_rules_and_cells_of_a_drawn_table", "FLT-09": "test_rules_and_cells_of_a_drawn_table", "FLT-10": "line_bridges", "FLT-11": "ocr_cell_match", "FLT-12": "page_element_counts", "FLT-13": "flagged_elements", "FLT-14": "source_dispatch",
    "FLT-15": "load_imbalance", "FLT-16": "test_missing_models",
    "JOI-01": "ocr_cell_match table_cell_text", "JOI-02": "xycut_first_split", "JOI-03": "layout_nms", "JOI-04": "line_bridges", "JOI-05": "extended_lines test_rules_are_drawn_out_in_order", "JOI-06": "table_grid table_grid_drawn test_grid_by_hand", "JOI-07": "result_matching late_results test_stream_matching",
    "JOI-08": "shard_status", "JOI-09": "compare_runs", "JOI-10": "compare_runs", "JOI-11": "baseline_hash_check", "JOI-12": "table_row_diff", "JOI-13": "cer_pairs",
    "AGG-01": "stage_totals", "AGG-02": "document_tracked_time", "AGG-03": "tracked_time document_tracked_time", "AGG-04": "latency_percentiles test_percentiles", "AGG-05": "document_skipped", "AGG-06": "page_element_counts", "AGG-07": "ocr_region_text", "AGG-08": "page_markdown document_markdown",
    "AGG-09": "content_list", "AGG-10": "projection_profile", "AGG-11": "text_direction", "AGG-12": "table_validity", "AGG-13": "table_validity", "AGG-14": "table_grid table_grid_drawn test_grid_by_hand", "AGG-15": "table_grid table_grid_drawn test_grid_by_hand", "AGG-16": "test_components_match_flood_fill", "AGG-17": "test_wired_tables",
    "AGG-18": "shard_status shard_inflight", "AGG-19": "lock_stats lock_stage_totals", "AGG-20": "load_imbalance", "AGG-21": "fleet_status fleet_devices test_health_and_fleet", "AGG-22": "request_counters", "AGG-23": "bench_summary", "AGG-24": "bench_summary bench_cases", "AGG-25": "wave_throughput wave_summary",
    "AGG-26": "scaling_efficiency", "AGG-27": "scaling_verdict", "AGG-28": "pages_per_second", "AGG-29": "compare_summary", "AGG-30": "content_totals", "AGG-31": "table_logical_columns", "AGG-32": "cer_pairs", "AGG-33": "page_summaries", "AGG-34": "class_accuracy", "AGG-35": "tensor_diff",
    "WIN-01": "table_rows", "WIN-02": "projection_segments test_segments_with_and_without_counts", "WIN-03": "table_grid table_grid_drawn test_grid_by_hand", "WIN-04": "table_grid table_grid_drawn test_grid_by_hand", "WIN-05": "table_grid table_grid_drawn test_grid_by_hand", "WIN-06": "table_grid table_grid_drawn test_grid_by_hand",
    "WIN-07": "reading_order reading_order_drawn test_reading_order_by_hand", "WIN-08": "figure_elements equation_elements page_elements", "WIN-09": "layout_postprocess", "WIN-10": "test_file_sources",
    "SRT-01": "layout_nms test_suppression_of_many_pages_at_once", "SRT-02": "reading_order reading_order_drawn test_reading_order_by_hand", "SRT-03": "reading_order reading_order_drawn test_reading_order_by_hand", "SRT-04": "reading_order reading_order_drawn test_reading_order_by_hand", "SRT-05": "table_grid table_grid_drawn test_grid_by_hand",
    "SRT-06": "test_corners_and_box_info", "SRT-07": "test_folder_keeps_order_and_errors", "SRT-08": "topology_rank", "SRT-09": "bottlenecks", "SRT-10": "page_range", "SRT-11": "least_inflight_route", "SRT-12": "table_row_diff",
    "SET-01": "page_plan page_elements", "SET-02": "table_lines", "SET-03": "common_documents", "SET-04": "fleet_status", "SET-05": "duplicate_outputs duplicate_output_dirs",
    "SCA-01": "iou_pairs", "SCA-02": "iou_pairs", "SCA-03": "cosine_pairs", "SCA-04": "edit_distance edit_distance_whole", "SCA-05": "cer_pairs", "SCA-06": "test_corners_and_box_info", "SCA-07": "test_rules_are_drawn_out_in_order", "SCA-08": "table_html", "SCA-09": "element_markdown",
    "SCA-10": "flagged_elements", "SCA-11": "detail_report flagged_elements", "SCA-12": "safe_names", "SCA-13": "parse_flags parse_options", "SCA-14": "source_dispatch", "SCA-15": "base64_roundtrip", "SCA-16": "data_urls", "SCA-17": "base_urls", "SCA-18": "lock_stats",
    "SCA-19": "text_hashes canonical_hashes test_canonical_hashes", "SCA-20": "request_ids", "SCA-21": "request_warnings", "SCA-22": "service_status", "SCA-23": "table_logical_columns", "SCA-24": "table_pages", "SCA-25": "inline_image_markdown", "SCA-26": "markdown_diff test_diff_counts_lines_like_a_unified_diff",
    "SCA-27": "compare_runs", "SCA-28": "gate_status", "SCA-29": "detail_report", "SCA-30": "performance_table",
    "CMP-01": "layout_postprocess test_one_pass_equals_the_steps", "CMP-02": "page_elements page_elements_stages_off test_page_plan", "CMP-03": "page_elements test_page_plan", "CMP-04": "table_fallback_reason page_elements", "CMP-05": "unsupported_elements", "CMP-06": "figure_elements page_elements",
    "CMP-07": "equation_elements page_elements_stages_off", "CMP-08": "extended_lines table_grid test_table_from_pixels_to_grid", "CMP-09": "table_html", "CMP-10": "element_markdown document_markdown", "CMP-11": "content_list", "CMP-12": "middle_json", "CMP-13": "model_json", "REP-01": "detail_report",
    "CMP-14": "file_results file_payloads test_process_and_file_parse test_annotate", "CMP-15": "service_status", "CMP-16": "bench_cases bench_summary test_bench_text", "CMP-17": "topology_report topology_rank bottlenecks",
    "STR-01": "task_ids", "STR-02": "result_matching test_stream_matching", "STR-03": "result_matching test_stream_matching", "STR-04": "result_matching test_stream_matching", "STR-05": "late_results result_matching", "STR-06": "test_a_stream_started_afresh_counts_afresh",
    "STR-07": "test_last_sample_and_progress", "STR-08": "streaming_latency test_last_sample_and_progress", "STR-09": "test_last_sample_and_progress", "STR-10": "file_results test_one_bad_request_leaves_the_next_alone",
    "UDF-01": "plug-in test_stages_with_stand_ins", "UDF-02": "plug-in test_stages_with_stand_ins", "UDF-03": "table_html table_fallback_reason test_page_plan", "UDF-04": "plug-in test_stages_with_stand_ins", "UDF-05": "plug-in test_stages_with_stand_ins", "UDF-06": "plug-in test_stages_with_stand_ins",
    "UDF-07": "test_wired_tables", "UDF-08": "test_stages_with_stand_ins", "UDF-09": "test_stages_with_stand_ins",
    "API-01": "test_health_and_fleet", "API-02": "service_status", "API-03": "test_process_and_file_parse", "API-04": "test_process_and_file_parse", "API-05": "test_process_and_file_parse file_results file_payloads", "API-06": "test_annotate annotate_errors", "API-07": "test_health_and_fleet fleet_status",
    "API-08": "test_command_line", "API-09": "test_topologies", "API-10": "test_command_line bench_cases",
}
SIZES = {"SRC": 15, "SNK": 10, "PRJ": 18, "FLT": 16, "JOI": 13, "AGG": 35, "WIN": 10, "SRT": 12, "SET": 5, "SCA": 30, "CMP": 17, "REP": 1, "STR": 10, "UDF": 9, "API": 10}
IDS = [f"{k}-{i:02d}" for k, n in SIZES.items() for i in range(1, n + 1)]


def table() -> str:
    """The map as Markdown, a row for each family of operators."""
    rows = ["| operators | where |", "|---|---|"]
    for family, n in SIZES.items():
        names = list(dict.fromkeys(x for i in range(1, n + 1) for x in MAP[f"{family}-{i:02d}"].split()))
        rows.append(f"| {family}-01..{n:02d} | {', '.join(f'`{x}`' if x != 'plug-in' else x for x in names)} |")
    return "\n".join(rows)
