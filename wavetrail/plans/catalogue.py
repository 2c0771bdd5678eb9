"""Imports every plan module, which registers its queries."""

import wavetrail.plans.events  # noqa: F401
import wavetrail.plans.history  # noqa: F401
import wavetrail.plans.live  # noqa: F401
import wavetrail.plans.listings  # noqa: F401
import wavetrail.plans.emitters  # noqa: F401
import wavetrail.plans.messages  # noqa: F401
import wavetrail.plans.network  # noqa: F401
import wavetrail.plans.rules  # noqa: F401
import wavetrail.plans.spectrum  # noqa: F401
import wavetrail.plans.storage  # noqa: F401
import wavetrail.plans.streams  # noqa: F401
import wavetrail.plans.summary  # noqa: F401
