"""Imports every module of this package that registers queries."""

import wavetrail.llm.chat_format  # noqa: F401
import wavetrail.llm.secret_scan  # noqa: F401
import wavetrail.llm.license_scan  # noqa: F401
import wavetrail.llm.mixing  # noqa: F401
import wavetrail.llm.fingerprints  # noqa: F401
import wavetrail.llm.language_id  # noqa: F401
import wavetrail.llm.decontamination  # noqa: F401
import wavetrail.llm.relative_parse  # noqa: F401
import wavetrail.llm.suffix_dedup  # noqa: F401
import wavetrail.llm.jaccard_join  # noqa: F401
import wavetrail.llm.periodic_runs  # noqa: F401
import wavetrail.llm.quality_rules  # noqa: F401
import wavetrail.llm.conversation_repair  # noqa: F401
