"""Typed settings and their validation; read from TOML, unknown keys fail."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

POLICIES = ("stream_uniform", "document_uniform", "quality_tier", "quality_tier_length_balanced")
#: What an ablation turns on besides masking and decontamination, each with all before it.
ABLATION = ("raw", "heuristic", "dedup", "model_quality")


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


# The section and key names and the defaults of the configuration files, which must load as they are.
@dataclass(frozen=True)
class CurationConfig:
    input_path: str = ""
    validation_path: str = ""
    test_path: str = ""
    min_words: int = 20
    min_alpha_ratio: float = 0.6
    validation_fraction: float = 0.1
    near_dedup_threshold: float = 0.9
    ngram_size: int = 5
    num_hashes: int = 64
    num_bands: int = 8
    decontamination_threshold: float = 0.85
    enable_pii_masking: bool = True
    enable_quality_rules: bool = True
    enable_exact_dedup: bool = True
    enable_near_dedup: bool = True
    enable_decontamination: bool = True
    enable_model_quality: bool = False
    quality_seed_path: str = ""
    quality_threshold: float = 0.5
    quality_epochs: int = 40
    quality_learning_rate: float = 0.1
    quality_hash_dim: int = 2048

    def validate(self) -> CurationConfig:
        _check(self.min_words >= 1, "min_words must be positive")
        _check(0 <= self.min_alpha_ratio <= 1, "min_alpha_ratio must lie in [0, 1]")
        _check(0 < self.validation_fraction < 1, "validation_fraction must lie in (0, 1)")
        _check(0 <= self.near_dedup_threshold <= 1, "near_dedup_threshold must lie in [0, 1]")
        _check(0 <= self.decontamination_threshold <= 1, "decontamination_threshold must lie in [0, 1]")
        _check(self.ngram_size >= 1, "ngram_size must be positive")
        _check(self.num_hashes >= 1 and self.num_bands >= 1, "hash and band counts must be positive")
        _check(self.num_hashes % self.num_bands == 0, "num_hashes must be a multiple of num_bands")
        _check(0 <= self.quality_threshold <= 1, "quality_threshold must lie in [0, 1]")
        _check(self.quality_epochs >= 1 and self.quality_learning_rate > 0, "quality training needs epochs and a positive rate")
        _check(self.quality_hash_dim >= 32, "quality_hash_dim must be at least 32")
        _check(not self.test_path or bool(self.validation_path), "test_path needs a validation_path")
        return self

    def complete(self) -> CurationConfig:
        """As validate, for a project read from a file, whose model comes from its seed file."""
        self.validate()
        _check(not self.enable_model_quality or bool(self.quality_seed_path), "enable_model_quality needs a quality_seed_path")
        return self


@dataclass(frozen=True)
class VocabularyConfig:
    vocab_size: int = 512
    max_training_characters: int = 0

    def validate(self) -> VocabularyConfig:
        _check(self.vocab_size >= 258, "vocab_size must be at least 258")
        _check(self.max_training_characters >= 0, "max_training_characters must not be negative")
        return self


@dataclass(frozen=True)
class ModelConfig:
    """Sizes of a model that is trained elsewhere; read, checked and hashed, never built."""

    d_model: int = 256
    n_layers: int = 6
    n_heads: int = 8
    d_ff: int = 768
    max_seq_len: int = 256
    dropout: float = 0.0
    attention_impl: str = "sdpa"
    tie_embeddings: bool = True
    qk_norm: bool = False
    z_loss_weight: float = 0.0
    rope_theta: float = 10_000.0
    residual_scaled_init: bool = False
    vocab_size: int = 0

    def validate(self) -> ModelConfig:
        _check(min(self.d_model, self.n_layers, self.n_heads, self.d_ff, self.max_seq_len) >= 1, "model sizes must be positive")
        _check(self.d_model % (2 * self.n_heads) == 0, "d_model must be an even multiple of n_heads")
        _check(0 <= self.dropout < 1, "dropout must lie in [0, 1)")
        _check(self.attention_impl in ("eager", "sdpa"), "attention_impl must be eager or sdpa")
        _check(self.z_loss_weight >= 0 and self.rope_theta > 0, "z_loss_weight must not be negative and rope_theta positive")
        return self


@dataclass(frozen=True)
class ScheduleConfig:
    steps: int = 500
    batch_size: int = 16
    seq_len: int = 128
    gradient_accumulation_steps: int = 1
    learning_rate: float = 6e-4
    min_learning_rate_ratio: float = 0.1
    weight_decay: float = 0.1
    warmup_steps: int = 20
    gradient_clip: float = 1.0
    eval_interval: int = 25
    eval_batches: int = 10
    checkpoint_interval: int = 100
    device: str = "auto"
    lr_schedule: str = "cosine"
    wsd_decay_steps: int = 0
    precision: str = "fp32"
    compile_model: bool = False
    activation_checkpointing: bool = False
    fused_optimizer: bool = False
    peak_tflops: float = 0.0
    sampling_policy: str = "stream_uniform"
    quality_tier_probabilities: tuple[float, float, float] = (0.1, 0.3, 0.6)

    def validate(self) -> ScheduleConfig:
        counts = (self.steps, self.batch_size, self.seq_len, self.gradient_accumulation_steps, self.eval_interval, self.eval_batches, self.checkpoint_interval)
        _check(min(counts) >= 1, "steps, sizes and intervals must be positive")
        _check(self.learning_rate > 0 and 0 <= self.min_learning_rate_ratio <= 1, "learning rate out of range")
        _check(self.gradient_clip > 0 and self.peak_tflops >= 0, "gradient_clip must be positive and peak_tflops not negative")
        _check(0 <= self.warmup_steps <= self.steps, "warmup_steps must lie in [0, steps]")
        _check(self.lr_schedule in ("cosine", "wsd"), "lr_schedule must be cosine or wsd")
        _check(0 <= self.wsd_decay_steps <= self.steps - self.warmup_steps, "wsd_decay_steps must fit after the warm-up")
        _check(self.lr_schedule != "wsd" or self.wsd_decay_steps > 0, "wsd needs wsd_decay_steps")
        _check(self.precision in ("fp32", "bf16"), "precision must be fp32 or bf16")
        _check(self.sampling_policy in POLICIES, f"sampling_policy must be one of {', '.join(POLICIES)}")
        p = self.quality_tier_probabilities
        _check(len(p) == 3 and min(p) >= 0 and abs(sum(p) - 1) < 1e-9, "tier probabilities must be three and sum to 1")
        return self


@dataclass(frozen=True)
class GenerationConfig:
    prompt: str = "Once upon a time"
    max_new_tokens: int = 80
    temperature: float = 0.8
    top_k: int = 40

    def validate(self) -> GenerationConfig:
        _check(self.max_new_tokens >= 1 and self.temperature > 0 and self.top_k >= 0, "generation settings out of range")
        return self


@dataclass(frozen=True)
class ProjectConfig:
    name: str = "corpus"
    seed: int = 42
    output_dir: str = "artifacts/default"
    root: str = "."
    data: CurationConfig = field(default_factory=CurationConfig)
    tokenizer: VocabularyConfig = field(default_factory=VocabularyConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    training: ScheduleConfig = field(default_factory=ScheduleConfig)
    generation: GenerationConfig = field(default_factory=GenerationConfig)

    @classmethod
    def from_toml(cls, path: str | Path) -> ProjectConfig:
        """Sections project, data, tokenizer, model, training and generation; unknown keys are an error; paths are relative to the parent of a configs folder."""
        place = Path(path).resolve()
        found = tomllib.loads(place.read_text(encoding="utf-8"))
        sections = {"data": CurationConfig, "tokenizer": VocabularyConfig, "model": ModelConfig, "training": ScheduleConfig, "generation": GenerationConfig}
        unknown = set(found) - {"project", *sections}
        _check(not unknown, f"unknown sections: {sorted(unknown)}")
        parts: dict[str, Any] = {}
        for key, kind in sections.items():
            values = {k: tuple(v) if isinstance(v, list) else v for k, v in found.get(key, {}).items()}
            extra = set(values) - {f.name for f in fields(kind)}
            _check(not extra, f"unknown keys in {key}: {sorted(extra)}")
            parts[key] = kind(**values)
        root = place.parent.parent if place.parent.name == "configs" else place.parent
        return cls(root=str(root), **found.get("project", {}), **parts).validate()

    def validate(self) -> ProjectConfig:
        self.data.complete()
        for part in (self.tokenizer, self.model, self.training, self.generation):
            part.validate()
        _check(self.training.seq_len <= self.model.max_seq_len, "seq_len must not exceed max_seq_len")
        return self

    def path(self, value: str) -> str:
        """A path of the file, relative ones to the root; an address with a scheme stays as it is."""
        return value if "://" in value else str(Path(self.root) / value)

    @property
    def artifact_dir(self) -> str:
        return self.path(self.output_dir)

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)
