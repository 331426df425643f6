"""Sinks: results, feature caches, reports, captions, trainer configurations and workflow documents.

Files that other programs expect one by one are written by the executors from plan tables; paths must then
be on a store that all of them mount.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.snapshots import Snapshots

c = F.col


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_cache(rows: DataFrame, path: str, version: int = 2) -> None:
    """Puts the rows of this run in the place of a feature cache, as a whole; ``rows`` may come from the cache itself."""
    Snapshots(rows.sparkSession, path, ["file_key"]).commit(rows.withColumn("version", F.lit(version)), replace=True)


def write_lines(lines: DataFrame, path: str) -> None:
    """An ordered ``(ord, line)`` table as one text file; a report is small by its nature."""
    lines.orderBy("ord").select("line").coalesce(1).write.mode("overwrite").text(path)


def report_lines(grade: DataFrame, coverage: DataFrame, scores: DataFrame, advice: DataFrame, next_shots: DataFrame | None = None, actions: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """``(ord, line)`` of a report: grade, coverage, missing shots, actions, target scores, recommendations, images."""
    place = lambda part, col: F.concat(F.lit(part), F.lpad(c(col).cast("string"), 12, "0"))
    parts = [
        grade.select(F.lit("0").alias("ord"), F.concat(F.lit("grade "), c("grade"), F.lit(", usable "), c("n_yes").cast("string"), F.lit(" of "), c("total").cast("string")).alias("line")),
        coverage.select(F.concat(F.lit("1"), c("part")).alias("ord"), F.format_string("coverage %s: %d (%s)", "part", "n", "state").alias("line")),
        scores.select(F.concat(F.lit("4"), c("family")).alias("ord"), F.format_string("target %s: %d %s", "family", "score", "grade").alias("line")),
        advice.select(place("5", "ord").alias("ord"), F.format_string("advice %s: %d", "code", "n").alias("line")),
    ]
    if next_shots is not None:
        parts.append(next_shots.select(place("2", "ord").alias("ord"), F.format_string("missing %s: %d", "shot", "n").alias("line")))
    if actions is not None:
        parts.append(actions.select(place("3", "ord").alias("ord"), F.format_string("action %s: %d", "code", "n").alias("line")))
    if images is not None:
        parts.append(images.select(place("6", "image_id").alias("ord"), F.format_string("image %s: %s (%s)", "name", "viable", "reason").alias("line")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def put(path: str, body: bytes, overwrite: bool = True, least: int = 0) -> str:
    """Writes one file whole or not at all; ``kept`` where one of more than ``least`` bytes is there already.

    Attempts at the same time have drafts of their own.
    """
    if not overwrite and os.path.exists(path) and os.path.getsize(path) > least - (least == 0):
        return "kept"
    try:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{path}.{uuid.uuid4().hex}.part"
        with open(draft, "wb") as f:
            f.write(body)
        os.replace(draft, path)
        return "written"
    except OSError:
        return "error"


def write_texts(plan: DataFrame, overwrite: bool = True) -> DataFrame:
    """Writes each ``(path, body)``; returns ``(path, state)`` with written, kept or error. Names are unique, so reruns agree."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            states = [put(path, (body or "").encode(), overwrite) for path, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(states, pa.string())], ["path", "state"])

    return plan.select("path", "body").mapInArrow(run, "path string, state string")


def write_training_images(plan: DataFrame) -> DataFrame:
    """Writes a PNG for each ``(path, content, box, size)``: the box cut out and brought to ``size`` (w, h); a null box is all.

    Returns ``(path, state)``: written, ``unreadable`` for what no decoder reads, or error. Each row is one file, so that
    a task that runs again writes the same.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from quarry.sources.files import decode_png, encode_png, resized

        for b in batches:
            states = []
            for path, raw, box, size in zip(*(b.column(i).to_pylist() for i in range(4))):
                pixels = decode_png(raw or b"")
                if pixels is None:
                    states.append("unreadable")
                    continue
                pixels = pixels[:, :, :3] if pixels.shape[2] >= 3 else pixels[:, :, [0, 0, 0]]
                part = pixels[box["y1"] : box["y2"], box["x1"] : box["x2"]] if box else pixels
                states.append(put(path, encode_png(resized(part, size["w"], size["h"]))) if part.size else "error")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(states, pa.string())], ["path", "state"])

    return plan.select("path", "content", "box", "size").mapInArrow(run, "path string, state string")


def write_masks(masks: DataFrame, threshold: float | None = None, least: int = 100) -> DataFrame:
    """Writes a grey PNG for each ``(path, height, width, mask array<float>)``; a file of more than ``least`` bytes stays.

    Masks come from a provider, in any range, row by row; they are stretched to 0 to 255. Returns ``(path, state)``:
    written, kept, or error for a mask that doesn't fill its size.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from quarry.sources.files import encode_png, normalise_mask

        for b in batches:
            states = []
            for path, h, w, mask in zip(*(b.column(i).to_pylist() for i in range(4))):
                if mask is None or not h or len(mask) != h * w:
                    states.append("error")
                else:
                    states.append(put(path, encode_png(normalise_mask(np.array(mask, np.float64).reshape(h, w), threshold)), overwrite=False, least=least))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(states, pa.string())], ["path", "state"])

    return masks.select("path", "height", "width", "mask").mapInArrow(run, "path string, state string")


def write_config(config: dict, path: str) -> None:
    """Settings as JSON, whole or not at all."""
    if put(path, json.dumps(config, indent=2, ensure_ascii=False).encode()) != "written":
        raise OSError(f"can't write {path}")


def caption_files(plan: DataFrame, folder: str) -> DataFrame:
    """``(path, body)`` of the captions of an export plan."""
    return plan.select(F.concat(F.lit(f"{folder}/"), c("out_name"), F.lit(".txt")).alias("path"), c("caption").alias("body"))


#: The file each configuration format is kept in; ``onetrainer_hint`` has none.
CONFIG_FILES = {
    "kohya_toml": "dataset_config.toml",
    "kohya_toml_flux": "kohya_flux_config.toml",
    "aitoolkit_yaml": "ai_toolkit_config.yaml",
    "musubi_toml": "musubi_dataset.toml",
    "diffpipe_toml": "diffusion_pipe_config.toml",
    "kohya_toml_sd35": "kohya_sd35_config.toml",
    "kohya_toml_hunyuan_dit": "kohya_hunyuan_dit_config.toml",
    "aitoolkit_yaml_chroma": "ai_toolkit_chroma_config.yaml",
    "diffpipe_toml_sana": "diffusion_pipe_sana.toml",
    "musubi_toml_wan21": "musubi_wan21_dataset.toml",
    "diffpipe_toml_ltx": "diffusion_pipe_ltx.toml",
    "diffpipe_toml_cogvideox": "cogvideox_factory_config.yaml",
    "diffpipe_toml_mochi": "diffusion_pipe_mochi.toml",
    "diffpipe_toml_opensora": "diffusion_pipe_opensora.toml",
}

#: Model files that a script for each format looks for, and the model type of a diffusion pipe.
_WEIGHTS = {
    "kohya_toml_flux": {"pretrained_model_name_or_path": "flux1-dev.safetensors", "ae": "ae.safetensors", "clip_l": "clip_l.safetensors", "t5xxl": "t5xxl_fp16.safetensors"},
    "kohya_toml_sd35": {"pretrained_model_name_or_path": "sd3.5_large.safetensors", "clip_l": "clip_l.safetensors", "clip_g": "clip_g.safetensors", "t5xxl": "t5xxl_fp16.safetensors"},
    "kohya_toml_hunyuan_dit": {"pretrained_model_name_or_path": "hunyuan_dit.safetensors", "vae": "vae.safetensors"},
}
_PIPES = {"diffpipe_toml": "hunyuan-video", "diffpipe_toml_sana": "sana", "diffpipe_toml_ltx": "ltx-video", "diffpipe_toml_mochi": "mochi", "diffpipe_toml_opensora": "open-sora"}


def _toml(sections: list[tuple[str, dict]]) -> str:
    """TOML text; a section named in double brackets is an entry of a list, the empty name the top."""
    lines = []
    for name, pairs in sections:
        if name:
            lines += ["", f"[{name}]"]
        lines += [f"{k} = {json.dumps(v, ensure_ascii=False)}" for k, v in pairs.items()]
    return "\n".join(lines).strip() + "\n"


def _yaml(value, depth: int = 0) -> list[str]:
    pad, lines = "  " * depth, []
    for k, v in value.items():
        if isinstance(v, dict):
            lines += [f"{pad}{k}:", *_yaml(v, depth + 1)]
        elif isinstance(v, list) and v and isinstance(v[0], dict):
            lines.append(f"{pad}{k}:")
            for item in v:
                first, *rest = _yaml(item, depth + 2)
                lines += [f"{pad}  - {first.strip()}", *rest]
        else:
            lines.append(f"{pad}{k}: {json.dumps(v, ensure_ascii=False)}")
    return lines


def config_text(target: dict, persona: str, folder: str) -> str | None:
    """A target's training configuration in the format its trainer reads; null for a target without file."""
    kind, out = target["config_format"], f"{folder}/output"
    repeats, sizes = target["repeats"] or 10, [[r["w"], r["h"]] for r in target["resolutions"]]
    pictures = f"{folder}/{repeats}_{persona}" if target["folder_naming"] == "kohya" else f"{folder}/images"
    subset = {"image_dir": pictures, "num_repeats": repeats}
    network = {"network_module": "networks.lora", "network_dim": target["dim"], "network_alpha": target["alpha"]}
    if kind == "kohya_toml":
        return _toml([("general", {"shuffle_caption": False, "caption_extension": ".txt", "keep_tokens": 1}), ("[datasets]", {"resolution": sizes[0][0], "batch_size": 1}), ("[datasets.subsets]", subset)])
    if kind in _WEIGHTS:
        training = {
            "output_dir": out, "output_name": f"{persona}_lora", "train_data_dir": folder, "resolution": f"{sizes[0][0]},{sizes[0][1]}", "caption_extension": ".txt", "max_train_epochs": target["epochs"], "train_batch_size": 1,
            "learning_rate": target["learning_rate"], "mixed_precision": "bf16", "save_model_as": "safetensors", "gradient_checkpointing": True,
        }
        return _toml([("model", _WEIGHTS[kind]), ("network", network), ("training", training)])
    if kind.startswith("aitoolkit"):
        process = {
            "type": "sd_trainer", "training_folder": out, "device": "cuda:0", "trigger_word": persona, "network": {"type": "lora", "linear": target["dim"], "linear_alpha": target["alpha"]},
            "datasets": [{"folder_path": pictures, "caption_ext": "txt", "resolution": sorted({max(s) for s in sizes})}], "train": {"batch_size": 1, "epochs": target["epochs"], "lr": target["learning_rate"], "optimizer": "adamw8bit", "dtype": "bf16"},
            "model": {"name_or_path": "chroma" if kind.endswith("chroma") else "flux1-dev", "arch": "chroma" if kind.endswith("chroma") else "flux", "quantize": True},
        }
        return "\n".join(_yaml({"job": "extension", "config": {"name": f"{persona}_lora", "process": [process]}})) + "\n"
    if kind.startswith("musubi"):
        general = {"resolution": sizes[0], "caption_extension": ".txt", "batch_size": 1, "enable_bucket": True, "bucket_no_upscale": False}
        return _toml([("general", general), ("[datasets]", {"image_directory": pictures, "cache_directory": f"{folder}/cache", "num_repeats": repeats})])
    if kind == "diffpipe_toml_cogvideox":
        data = {"data_root": pictures, "id_token": persona, "image_resolution_buckets": [f"{w}x{h}" for w, h in sizes]}
        training = {"training_type": "lora", "rank": target["dim"], "lora_alpha": target["alpha"], "train_epochs": target["epochs"], "learning_rate": target["learning_rate"], "batch_size": 1, "mixed_precision": "bf16"}
        return "\n".join(_yaml({"model": {"model_name": "cogvideox", "pretrained_model_name_or_path": "CogVideoX-5b"}, "dataset": data, "training": training, "output_dir": out})) + "\n"
    if kind in _PIPES:
        top = {"output_dir": out, "epochs": target["epochs"], "micro_batch_size_per_gpu": 1, "save_every_n_epochs": 1, "activation_checkpointing": True}
        adapter = {"type": "lora", "rank": target["dim"], "dtype": "bfloat16"}
        data = {"resolutions": sizes, "enable_ar_bucket": True, "num_repeats": repeats}
        return _toml([("", top), ("model", {"type": _PIPES[kind], "dtype": "bfloat16"}), ("adapter", adapter), ("optimizer", {"type": "adamw_optimi", "lr": target["learning_rate"]}), ("dataset", data), ("[dataset.directory]", {"path": pictures})])
    return None


def launch_text(target: dict, persona: str, folder: str) -> str:
    """What to know of an exported folder: target, counts to expect, and how its trainer is started."""
    kind = target["config_format"]
    start = {
        "kohya": "accelerate launch train_network.py --dataset_config <file>" if kind == "kohya_toml" else "accelerate launch train_network.py --config_file <file>", "aitool": "python run.py <file>",
        "musubi": "accelerate launch train_network.py --dataset_config <file>", "diffpi": "deepspeed train.py --deepspeed --config <file>",
    }
    step = start.get(kind[:6], start.get(kind[:5], "open the folder in the trainer's window"))
    file = CONFIG_FILES.get(kind)
    lines = [
        f"Target: {target['label']} ({target['key']})", f"Trigger word: {persona}", f"Pictures and captions: {folder}", f"Sizes: {', '.join(str(r['w']) + 'x' + str(r['h']) for r in target['resolutions'])}",
        f"Repeats {target['repeats'] or 10}, epochs {target['epochs']}, rank {target['dim']}, alpha {target['alpha']}, learning rate {target['learning_rate']}", f"Configuration: {file or 'none'}", f"Start: {step.replace('<file>', file or '')}",
    ]
    return "\n".join(lines) + "\n"


def _catalogue_files(targets: DataFrame, folder: str, each) -> DataFrame:
    """``(path, body)`` of a file for each target that ``each`` gives name and body for: a catalogue of 19 rows."""
    rows = []
    for row in targets.collect():
        target = row.asDict(recursive=True)
        home = f"{folder}/{target['key']}"
        name, body = each(target, home)
        if body is not None:
            rows.append((f"{home}/{name}", body))
    return targets.sparkSession.createDataFrame(rows, "path string, body string")


def config_files(targets: DataFrame, folder: str, persona: str) -> DataFrame:
    """``(path, body)`` of the configuration of every target that has a file."""

    def each(target: dict, home: str) -> tuple[str | None, str | None]:
        body = config_text(target, persona, home)
        return CONFIG_FILES.get(target["config_format"]), body and f'# target = "{target["key"]}", trigger = "{persona}"\n{body}'

    return _catalogue_files(targets, folder, each)


def launch_files(targets: DataFrame, folder: str, persona: str) -> DataFrame:
    """``(path, body)`` of the launch text of every target."""
    return _catalogue_files(targets, folder, lambda target, home: ("README.txt", launch_text(target, persona, home)))


def workflow_documents(suggestions: DataFrame, persona: str, reference: str) -> DataFrame:
    """``(category, document)``: a JSON workflow of reference, prompt and sampler nodes for each suggestion."""
    prompt = F.concat_ws(", ", F.lit(persona), c("fragment"))
    node = lambda i, kind, value: F.struct(F.lit(i).alias("id"), F.lit(kind).alias("type"), value.cast("string").alias("value"))
    nodes = F.array(node(1, "reference", F.lit(reference)), node(2, "prompt", prompt), node(3, "batch", c("n")), node(4, "sampler", F.lit("default")))
    links = F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in ((1, 4), (2, 4), (3, 4))))
    return suggestions.select("category", F.to_json(F.struct(nodes.alias("nodes"), links.alias("links"))).alias("document"))
