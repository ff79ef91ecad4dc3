"""Values of the campaign signals."""

# Promotional forms with weights, persona slots, masks of fillers, slots a platform asks for.
PROMO = (
    ("hype opener: address word", r"(?i)^\s*(sir|bro|guys|fam|ser|anon|frens?)\b[\s.,!…]*", 2),
    ("hype opener: alarm", r"(?i)^\s*(\x{1F6A8}|BREAKING\b|HUGE\b|this is (huge|insane|wild|massive)\b|holy (sh\w*|cow)\b|lfg\b|wait what\b)", 2),
    ("hype opener: drop announcement", r"(?i)\b(they|\w+) (just|finally) (dropped|shipped|released|launched)\b", 1),
    ("launch formula: fundamental bottleneck", r"(?i)\bis the (fundamental|biggest|real|core) bottleneck (for|in|of)\b", 2),
    ("launch formula: the infra that solves it", r"(?i)\b(will be|is|becomes) the (infra|infrastructure|platform|layer|rails) that (solves|fixes|powers|unlocks)\b", 2),
    ("launch formula: we spent the last N years", r"(?i)\bwe('ve)? spent the (last|past) (\w+|\d+) (years?|months?) building\b", 2),
    ("launch formula: the best solution", r"(?i)\bthe (best|only|ultimate) (solution|platform|tool|way) for\b", 2),
    ("launch formula: best-in-class", r"(?i)\b(best[- ]in[- ]class|state[- ]of[- ]the[- ]art|world[- ]class|game[- ]?changer|next[- ]level)\b", 1),
    ("launch formula: introducing X, its first Y", r"(?i)\b(introducing|meet|say hello to)\b[^.\n]{0,60}?\b(first|newest|latest)\b[^.\n]{0,20}?:", 2),
    ("launch formula: X launches Y, its first Z", r"(?i)\b(launch(es|ed)|unveil(s|ed)|release[sd])\b[^.\n]{0,60}?,\s*(its|their) (first|newest|latest)\b", 2),
    ("launch formula: built with our", r"(?i)\bbuilt (with|on) our (own )?(automated|proprietary|in-house|novel)\b", 1),
    ("launch formula: excited to announce", r"(?i)\b(we're|we are|i'm|i am) (so |super |incredibly )?(thrilled|excited|proud) to (announce|introduce|share|launch)\b", 1),
)
SPEC = r"(?i)\b\d[\d,.]*\s?(tokens?/s(ec)?|tok/s|t/s|x faster|x cheaper|%|ms|fps|[kmb] params|b parameters|gb|tb|tflops|qps|rps)\b|\b\d+x\b"
ENDORSE = r"(?i)\b(you (need|have|gotta|got) to (try|check)|go (check|try) (it|this|them) out|use (my )?code\b|link (in|below)|check (it|them) out\b|can'?t recommend .{0,20} enough|this changes everything|don'?t sleep on|i'?ve been using .{0,30} and (it|i))"
DISCLOSURE = r"(?i)(#ad\b|#sponsored|#partner|#paid|paid partnership|sponsored by|in partnership with|\bdisclosure\b|\bi was paid\b|\bthey paid me\b|\bi('m| am) an? (advisor|investor|employee)|\bi work (at|for)\b|\baffiliate\b|\bgifted\b)"
ACRONYMS = ('API', 'CUDA', 'GPUS', 'HTML', 'HTTP', 'JSON', 'LLMS', 'NASA', 'SDK', 'TFLOPS')
SLOTS = (
    ("age", "age slot", r"(?i)\b(age \d{2}|\d{2}[- ]?(year[- ]old|years? old|yo|y/o)|\d{2}\s*years? young)\b"),
    ("age", "age tagline", r"(?i)\bstill young at heart\b"),
    ("role", "role-in-place frame", r"\b([Aa]n?)\s+([A-Z][\w-]+(\s[A-Z][\w-]+)?)\s+(in|from|based in)\s+([A-Z][\w-]+)"),
    ("role", "dreamer role", r"(?i)\b(\d{2}[- ]year[- ]old |a |an )?(dreamer|hustler|believer|visionary|degen)\b"),
    ("hobby", "passionate-about frame", r"(?i)\b(passionate about|enjoying life with|obsessed with|in love with|lover of|addicted to|living for|fan of)\s+([\w$#][\w$# -]{1,30})"),
    ("token", "token ticker", r"(?<![\w$])\$[A-Z]{2,6}\b"),
    ("token", "stacking frame", r"(?i)\b(stacking|stacking up|hodling|holding|accumulating)\s+\$?[A-Z]{2,6}\b"),
    ("token", "crypto-is-the-future tagline", r"(?i)\b(crypto|web3|bitcoin|blockchain|defi) (is the future|will change the world|forever|to the moon)\b"),
    ("token", "chasing frame", r"(?i)\bchasing (dreams|gains|the moon|bags)\b"),
    ("tagline", "like-a-pro tagline", r"(?i)\blike a (pro|boss|legend)\b"),
    ("tagline", "memes tagline", r"(?i)\bhere for the (memes|vibes|gains|culture)\b"),
    ("tagline", "pet tagline", r"(?i)\b(cat|dog) (person|lover|mom|dad|parent)\b|\bproud (cat|dog) (mom|dad|owner)\b"),
    ("tagline", "traveler tagline", r"(?i)\b(traveler|traveller|wanderer|explorer)\b"),
    ("tagline", "pipe-separated tagline", r"\s\|\s*[A-Z][\w ]{2,25}\.?\s*$"),
)
FRAME_MASKS = (
    (r"\b\d{2}\b", r"<N>"),
    (r"(?<![\w$])\$?[A-Z]{2,6}\b", r"<TOKEN>"),
    (r"\b(in|from|based in)\s+[A-Z][\w-]+", r"$1 <PLACE>"),
    (r"\b([Aa]n?)\s+[A-Z][\w-]+(\s[A-Z][\w-]+)?\s+(in|from|based in)\b", r"a <ROLE> $3"),
    (r"(?i)\b(passionate about|enjoying life with|obsessed with|in love with|lover of|addicted to|living for|fan of)\s+[\w$#][\w$#-]*", r"$1 <HOBBY>"),
)
MIN_SLOTS = {'x': 3, 'reddit': 3, 'tiktok': 3, 'linkedin': 4, 'generic': 3}
