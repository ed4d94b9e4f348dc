"""Classes of mnemonics by machine: arithmetic, logic, transfer, call, conditional and unconditional jumps, stack, compare.

Machines are the families x86, arm and mips, without their width. A mnemonic can be in several classes of its machine, or in none. The
classes of conditional Arm mnemonics come from a rule: a stem, a condition, and for stems that can set flags an s before or after the condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Conditions of Arm mnemonics.
CONDITIONS = "eq ne cs hs cc lo mi pl vs vc hi ls ge lt gt le al nv".split()
# Stems of Arm's arithmetic mnemonics that take a condition; those that take a condition and an s.
ARM_STEMS = """asx qadd qadd16 qadd8 qasx qdadd qdsub qsax qsub qsub16 qsub8 rsb sadd16 sadd8 sasx sbc sdiv shadd16 shadd8 shasx shsax shsub16 shsub8
smlabb smlabt smlad smladx smlalbb smlalbt smlald smlaltb smlaltt smlatb smlatt smlsd smlsdx smlsld smlsldx smmla smmlar smmls smmlsr smmul smmulr smuad smuadx
smusd smusdx ssat ssat16 ssax ssub16 ssub8 uadd16 uadd8 uasx udiv uhadd16 uhadd8 uhasx uhsax uhsub16 uhsub8 umaal umul uqadd16 uqadd8 uqasx uqsax uqsub16
uqsub8 usad8 usada8 usat usat16 usax usub16 usub8""".split()
ARM_FLAG_STEMS = "adc add mla mls mul rsb rsc sbc smlal smull sub umlal umull".split()
# The mnemonics of each class that no rule gives. `or` and `not` of x86 count as arithmetic only.
LISTED = {
    ("arm", "arithmetic"): "ldrsb",
    ("arm", "logic"): """and andeq andge andgt andhi andhs andlt andne ands asr asral asrcc asrcs asreq asrge asrgt asrhi asrhs asrle asrlo asrls asrlt asrmi asrne asrnv asrpl asrvc asrvs
        bic bicge bicne bics lsl lsleq lslgt lslle lsllo lslne lsr lsreq lsrgt lsrhs lsrle lsrne lsrs lsrsne neg orr orreq orrge orrgt orrhi orrhs orrlo orrls orrlt orrne orrs ror
        rrx rrxal rrxals rrxcc rrxccs rrxcs rrxcss rrxeq rrxeqs rrxge rrxges rrxgt rrxgts rrxhi rrxhis rrxhs rrxhss rrxle rrxles rrxlo rrxlos rrxls rrxlss rrxlt rrxlts rrxmi rrxmis rrxne rrxnes rrxnv rrxnvs
        rrxpl rrxpls rrxs rrxvc rrxvcs rrxvs rrxvss vneg vqneg""",
    ("arm", "stack"): "pop popeq pophs pople poplt popne push",
    ("arm", "unconditional"): "b bal bx",
    ("arm", "conditional"): """bal bcc bcs beq bge bgt bhi bhs ble blo bls blt bmi bne bpl bvc bvs blal blcc blcs bleq blge blgt blhi blhs blle bllo blls bllt blmi blne blnv blpl blvc blvs
        blxal blxcc blxcs blxeq blxge blxgt blxhi blxhs blxle blxlo blxls blxlt blxmi blxne blxnv blxpl blxvc blxvs bx bxal bxcc bxcs bxeq bxge bxgt bxhi bxhs bxle bxlo bxls bxlt bxmi bxne bxnv bxpl bxvc bxvs
        it ite itee iteee iteet itet itete itett itt itte ittee ittet ittt ittte itttt""",
    ("arm", "call"): "bl blx",
    ("arm", "transfer"): "ldm ldr ldrex ldrexd mar mov movt mra mvn pld pldw pli stm str strex strexd",
    ("x86", "arithmetic"): """aaa aad aam aas adc adcx add addpd addps addsd addsubpd addsubps adox cbw cdq cwd cwde daa das dec div divpd divps divsd dppd dpps f2xm1 fabs fadd faddp fcos
        fdiv fdivp fiadd fidiv fimul fisub fisubr fmul fmulp fpatan fprem fprem1 fptan frndint fscale fsin fsincos fsqrt fsub fsubp fsubr fsubrp fyl2x fyl2xp1 haddpd haddps hsubpd hsubps idiv imul inc
        kaddb kaddd kaddq kaddw maxpd maxps maxsd minpd minps minsd mul mulpd mulps mulsd mulx neg not or paddb paddd paddq paddsb paddsw paddusb paddusw paddw pavgb pavgw phaddd phaddsw phaddw phminposuw
        phsubd phsubsw phsubw pmaddubsw pmaddwd pmaxsb pmaxsd pmaxsq pmaxsw pmaxub pmaxud pmaxuq pmaxuw pminsb pminsd pminsq pminsw pminub pminud pminuq pminuw pmuldq pmulhrsw pmulhuw pmulhw pmulld pmullq
        pmullw pmuludq psadbw psubb psubd psubq psubsb psubsw psubusb psubusw roundpd roundps roundsd rsqrtps sbb sqrtpd sqrtps sqrtsd sub subpd subps subsd vfmadd132pd xadd""",
    ("x86", "logic"): """and andn andnpd andnps andpd andps kandb kandd kandnb kandnd kandnq kandnw kandq kandw knotb knotd knotq knotw kord korq kortestb kortestd kortestq kortestw korw
        kshiftlb kshiftld kshiftlq kshiftlw kshiftrb kshiftrd kshiftrq kshiftrw kxorb kxord kxorq kxorw psllq pslld psllw psrab psrad psraq psraw psrlb psrld psrlq psrlw pxor rcl rcr rol ror rorx
        sal sar sarx shl shld shlx shr shrd shrx test xor xorpd""",
    ("x86", "stack"): "pop popa popad popal popd popf popfd popfq push pusha pushad pushd pushf pushfd pushfq",
    ("x86", "unconditional"): "int int1 into iret iretd jmp leave ret syscall sysenter sysexit",
    ("x86", "conditional"): "ja jae jb jbe jc jcxz je jecxz jg jge jl jle jna jnae jnb jnbe jnc jne jng jnge jnl jnle jno jnp jns jnz jo jp jpe jpo js jz loop loope loopne",
    ("x86", "call"): "call",
    ("x86", "transfer"): """bndldx bndmk bndmov bndstx cmova cmovl cmovng cmovno cmovnp cmovnz cmovo cmovp cmovpe cmovpo cmovz fist fistp fisttp fsave kmovb kmovd kmovq kmovw lddqu lds lea
        lods lodsb lodsd lodsq lodsw lsl lss mov movapd movaps movb movbe movd movddup movdq2q movdqa movdqu movhlps movhpd movhps movlhps movlpd movlps movmskps movntdq movntq movq movs movsb movsd
        movsq movss movsw movsx movsxd movupd movups movzx pmovmskb pmovsx pmovzx push pusha pushad pushf stos stosb stosd stosq stosw vbroadcast vexpandpd vexpandps vmovdqa32 vmovdqa64 vmovdqu16
        vmovdqu32 vmovdqu64 vmovdqu8 vpbroadcast vpbroadcastb vpexpandd vpexpandq""",
    ("x86", "compare"): "cmp cmppd cmpps cmps cmpsb cmpsd cmpsq cmpsw cmpxchg cmpxchg16b cmpxchg8b comisd fcomi fcomip fcomp fcompp ficom ficomp ftst ptest test ucomisd xtest",
    ("mips", "arithmetic"): """add add. add.d add.ps add.s addi addiu addiupc addiur1sp addiur2 addius5 addiusp addu addu16 clz dadd daddi daddiu daddu dclz ddiv ddivu div div. div.d div.s divu
        dmod dmodu dmuh dmuhu dmul dmult dmulu dsub dsubu floor. floor.l. floor.l.d floor.l.s floor.w. floor.w.d floor.w.s madd madd.d madd.ps madd.s maddf.d maddf.s maddu max.d max.s maxa.d maxa.s
        min.d min.s mina.d mina.s mod modu msub msub. msub.d msub.ps msub.s msubf.d msubf.s msubu muh muhu mul mul. mul.d mul.ps mul.s mult multu mulu nmadd. nmadd.d nmadd.ps nmadd.s nmsub. nmsub.d
        nmsub.ps nmsub.s round. round.l. round.l.d round.l.s round.w. round.w.d round.w.s seb seh sub sub. sub.d sub.ps sub.s subu subu16""",
    ("mips", "logic"): """and and16 andi andi16 drotr drotr32 drotrv dsll dsll32 dsllv dsra dsra32 dsrav dsrl dsrl32 dsrlv neg. neg.d neg.ps neg.s negu nor or or16 ori rotr rotrv
        sll sll16 sllv sra srav srl srl16 srlv xor xor16 xori""",
    ("mips", "unconditional"): "b bal balc bc bc16 j jr jr.hb jrc jrc16 syscall",
    ("mips", "conditional"): """bc1eqz bc1eqzc bc1f bc1fl bc1nez bc1nezc bc1t bc1tl bc2eqz bc2eqzc bc2f bc2fl bc2nez bc2nezc bc2t bc2tl bczt bcztl beq beql beqz beqzalc beqzc16 bgez bgezal
        bgezalc bgezall bgezl bgtz bgtzalc bgtzl blez blezalc blezl bltz bltzal bltzalc bltzall bltzl bne bnel bnez bnezalc bnezc16 teq teqi""",
    ("mips", "call"): "jal jalr jalr.hb jalrc jalrc.hb jalrc16 jalx",
    ("mips", "transfer"): """lb lbe lbu lbue ld ldc1 ldc2 lde ldl ldpc ldr ldu ldue ldxc1 lh lhe lhu lhue ll lld lldp lle llwp llwpe lsa luxc1 lw lwc1 lwc2 lwl lwle lwpc lwr lwre lwu mov
        sb sbe sc scd scdp sce scwp scwpe sd sdbbp sdc1 sdc2 sdl sdr sdxc1 sh she shu sw swc1 swc2 swe swl swle swr swre swxc1""",
}
#: The counters of feature tables, and the classes that each unites.
COUNTERS = {"call": ("call",), "redirect": ("conditional", "unconditional", "call"), "transfer": ("transfer",), "arith": ("arithmetic",), "logic": ("logic",)}


def members(machine: str, name: str) -> set[str]:
    """The mnemonics of a class of a machine; empty for an unknown machine or class."""
    out = set(LISTED.get((machine, name), "").split())
    if (machine, name) == ("arm", "arithmetic"):
        out |= {stem + c for stem in ARM_STEMS for c in ("", *CONDITIONS)}
        out |= {stem + x for stem in ARM_FLAG_STEMS for c in CONDITIONS for x in ("", "s", c, c + "s", "s" + c)}
    return out


def counters(spark: SparkSession) -> DataFrame:
    """machine, token and one BOOLEAN for each counter: a table of fixed size, about 3 000 rows."""
    rows = []
    for machine in ("arm", "mips", "x86"):
        of = {n: set().union(*(members(machine, c) for c in classes)) for n, classes in COUNTERS.items()}
        rows += [(machine, t, *(t in of[n] for n in COUNTERS)) for t in sorted(set().union(*of.values()))]
    return spark.createDataFrame(rows, "machine string, token string, " + ", ".join(f"is_{n} boolean" for n in COUNTERS))


def machine_of(arch: Column) -> Column:
    """The family of `x86-64`, `ARM-32`, ...; null for a null or unknown machine."""
    p = F.lower(F.trim(F.split_part(arch, F.lit("-"), F.lit(1))))
    return F.when(p.isin("x86", "arm", "mips"), p)
