"""Immutable configuration, merge and profile rules, and the dimensions made of it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from .functions import words as W


@dataclass(frozen=True)
class Profile:
    enabled: bool = False
    name: str = ""
    capabilities: dict[str, str] = field(default_factory=dict)
    ajax_prefixes: tuple[str, ...] = ()
    rest_namespaces: tuple[str, ...] = ()
    admin_rest_namespaces: tuple[str, ...] = ()
    custom_admin_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    custom: dict[str, str] = field(default_factory=dict)
    extended: dict[str, str] = field(default_factory=dict)
    core: tuple[tuple[int, tuple[str, ...]], ...] = tuple((lv, tuple(caps)) for lv, caps in ((6, W.CORE_SUPERADMIN), (5, W.CORE_ADMIN), (4, W.CORE_EDITOR), (3, W.CORE_AUTHOR), (2, W.CORE_CONTRIBUTOR), (1, W.CORE_SUBSCRIBER)))
    profiles: dict[str, Profile] = field(default_factory=dict)
    laravel_routes: bool = True
    generic_routers: bool = True
    ajax_admin_keywords: tuple[str, ...] = tuple(W.AJAX_ADMIN_KEYWORDS)
    ajax_admin_prefixes: tuple[str, ...] = ()
    user_facing: tuple[str, ...] = tuple(W.USER_FACING)
    rest_admin_namespaces: tuple[str, ...] = ()
    rest_public: tuple[str, ...] = tuple(W.REST_PUBLIC)
    rest_user: tuple[str, ...] = tuple(W.REST_USER)
    rest_admin: tuple[str, ...] = tuple(W.REST_ADMIN)
    namespace_constants: dict[str, str] = field(default_factory=dict)
    admin_patterns: tuple[str, ...] = ()
    vendor_dirs: tuple[str, ...] = tuple(W.VENDOR_DIRS)
    skip_composer_dirs: bool = True

    def merge(self, other: dict) -> Config:
        """Maps overlay, AJAX and REST lists append, framework, admin patterns and vendor dirs replace; core lists stay."""
        out = {}
        for k in ("custom", "extended", "namespace_constants", "profiles"):
            if k in other:
                out[k] = {**getattr(self, k), **other[k]}
        for k in ("ajax_admin_keywords", "ajax_admin_prefixes", "user_facing", "rest_admin_namespaces", "rest_public", "rest_user", "rest_admin"):
            if k in other:
                out[k] = (*getattr(self, k), *other[k])
        for k in ("admin_patterns", "vendor_dirs"):
            if k in other:
                out[k] = tuple(other[k])
        for k in ("laravel_routes", "generic_routers", "skip_composer_dirs"):
            if k in other:
                out[k] = other[k]
        return replace(self, **out)

    def add_profile(self, slug: str, profile: Profile) -> Config:
        """A profile that is enabled when added brings its prefixes, namespaces and patterns."""
        out = replace(self, profiles={**self.profiles, slug: profile})
        if profile.enabled:
            out = replace(out, ajax_admin_prefixes=(*self.ajax_admin_prefixes, *profile.ajax_prefixes), rest_admin_namespaces=(*self.rest_admin_namespaces, *profile.admin_rest_namespaces), admin_patterns=(*self.admin_patterns, *profile.custom_admin_patterns))
        return out

    def enable_profile(self, slug: str, on: bool = True) -> Config:
        if slug not in self.profiles:
            return self
        return replace(self, profiles={**self.profiles, slug: replace(self.profiles[slug], enabled=on)})

    def capability_level(self, cap: str) -> int | None:
        for given in (self.custom, self.extended):
            if cap in given:
                return level_of(given[cap])
        return next((lv for lv, caps in self.core if cap in caps), None)

    def capability_level_last(self, cap: str) -> int | None:
        """The second map: later (lower) lists overwrite earlier ones."""
        for given in (self.custom, self.extended):
            if cap in given:
                return level_of(given[cap])
        return next((lv for lv, caps in reversed(self.core) if cap in caps), None)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


def load_config(text: str) -> Config:
    """Merge JSON over the defaults."""
    return Config().merge(json.loads(text))


def level_of(name: str) -> int:
    """Ordinal of a level's name; ``user`` is a subscriber, unknown names are unauthenticated."""
    return 1 if name == "user" else W.LEVELS.index(name) if name in W.LEVELS else 0


def guard_level(cap: str) -> int:
    """The third capability map, of guard calls; unknown capabilities are a subscriber's."""
    if cap in W.GUARD_EXTRA:
        return W.GUARD_EXTRA[cap]
    level = None if cap in W.GUARD_MISSING else Config().capability_level_last(cap)
    return 1 if level is None else level


def capability_dim(spark: SparkSession, config: Config | None = None) -> DataFrame:
    """capabilities(cap, level_cfg, level_map, level_ast): a dimension of fixed size."""
    config = config or Config()
    caps = sorted({*config.custom, *config.extended, *(c for _, caps in config.core for c in caps), *W.GUARD_EXTRA})
    return spark.createDataFrame([(c, config.capability_level(c), config.capability_level_last(c), guard_level(c)) for c in caps], "cap string, level_cfg int, level_map int, level_ast int")


def level_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(W.LEVELS)), "auth_level int, name string")
