"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from rowkeel.llm import bpe, chat, crosspolytope, infill, leaks, lm, maxscore, minhash, mixing, quality, repeats, resample, secrets

QUERIES = {
    f.__name__: f
    for f in (
        mixing.op1_mixing,
        quality.op2_quality,
        lm.op3_hmm,
        minhash.op4_minhash,
        bpe.op5_bpe,
        repeats.op6_suffixes,
        maxscore.op7_maxscore,
        crosspolytope.op8_crosspolytope,
        secrets.op9_secrets,
        chat.op10_chat,
        infill.op11_infill,
        leaks.op12_leaks,
        resample.op13_resample,
    )
}

ORACLE = {
    "op7_maxscore": maxscore.ORACLE,
    "op9_secrets": secrets.ORACLE,
    "op10_chat": chat.ORACLE,
    "op11_infill": infill.ORACLE,
    "op12_leaks": leaks.ORACLE,
    "op13_resample": resample.ORACLE,
}
