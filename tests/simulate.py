"""Read pairs over a made-up reference with one heterozygous insertion, as SAM lines."""

import random

READ, INSERT = 100, 300
_FLIP = str.maketrans("ACGT", "TGCA")


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def flip(s):
    return s[::-1].translate(_FLIP)


def simulate(path, seed=5, length=20_000, right=9_988, tsd=12, tail=30, depth=50, element=280):
    """Insert an element with a tail before ``right + tsd``, so that the site of ``tsd`` bases is doubled.

    Returns the reference and the element. Reads of the other haplotype map whole; those over a
    junction are clipped, and those inside of the element are unmapped.
    """
    rng = random.Random(seed)
    ref = dna(rng, length)
    left = right + tsd
    inserted = dna(rng, element) + "A" * tail
    carrier = ref[:left] + inserted + ref[right:]
    window = (8_500, 11_500)
    lines = ["@HD\tVN:1.6\tSO:coordinate", f"@SQ\tSN:chr1\tLN:{length}", "@SQ\tSN:chr2\tLN:5000", "@RG\tID:a\tSM:made_up"]
    records = []

    def place(at, hap):
        """Start on the reference and CIGAR of a read at a haplotype's position; None if unmapped."""
        if hap is ref:
            return at, f"{READ}M"
        into, out = left, left + len(inserted)
        end = at + READ
        if end <= into:
            return at, f"{READ}M"
        if at >= out:
            return at - out + right, f"{READ}M"
        before, after = into - at, end - out
        if before >= max(after, 20):
            return at, f"{before}M{READ - before}S"
        if after >= 20:
            return right, f"{READ - after}S{after}M"
        return None

    for hap in (ref, carrier):
        span = window[1] - window[0]
        for k in range(span * depth // (2 * READ)):
            start = window[0] + rng.randrange(span)
            size = INSERT + rng.randrange(-30, 31)
            ends = [place(start, hap), place(start + size - READ, hap)]
            if ends == [None, None]:
                continue
            seqs = [hap[start : start + READ], hap[start + size - READ : start + size]]
            first_left = rng.random() < 0.5
            for i in (0, 1):
                own, mate = ends[i], ends[1 - i]
                flag = 1 | (64 if (i == 0) == first_left else 128)
                if own is None:
                    flag |= 4
                else:
                    flag |= 16 if i == 1 else 0
                if mate is None:
                    flag |= 8
                else:
                    flag |= 32 if i == 0 else 0
                tlen = 0
                if own and mate:
                    flag |= 2
                    tlen = (1 if i == 0 else -1) * (max(e[0] for e in ends) + READ - min(e[0] for e in ends))
                at = (own or mate)[0]
                tags = f"\tRG:Z:a\tMQ:i:60\tMC:Z:{mate[1]}" if mate else "\tRG:Z:a"
                name = f"{'r' if hap is ref else 'c'}{k}"
                records.append((at, f"{name}\t{flag}\tchr1\t{at + 1}\t{60 if own else 0}\t{own[1] if own else '*'}\t=\t{(mate or own)[0] + 1}\t{tlen}\t{seqs[i]}\t{'I' * READ}{tags}"))
    with open(path, "w") as out:
        out.write("\n".join([*lines, *(r for _, r in sorted(records))]) + "\n")
    return ref, inserted[: len(inserted) - tail]
