"""Words that neither the index nor a query keeps, by length and ending."""

CHINESE = tuple(
    """
不 与 为 之 也 了 于 从 他 以 会 但 你 便 其 再 别 到 却 又 及 只 同 向 和 在 地 太 她 它 对 将 就 并 当 很 得 我 或 把 按 是 更 最 有 未 比 的 着 第
等 给 而 能 被 要 让 谁 跟 还 这 那 都 并且 而且 这个 那个 作为 因为 什么 怎么 那么 为了 除了 关于 基于 对于 由于 至于 鉴于 一些 这些 那些 别人 不仅 可以 所以 他们
你们 她们 它们 我们 不会 不但 如何 即使 十分 否则 之前 上去 下去 过去 以及 不可 之后 以后 然后 正在 现在 能够 大家 多少 自己 非常 不得 不必 何时 于是 但是 还是 没有
下来 出来 起来 进来 如果 怎样 这样 那样 因此 如此 不然 虽然 一直 不管 尽管 始终 已经 曾经 或者 从而 因而 然而 不能 可能 不要 需要 不论 无论 应该 不过 哪里 除非 必须
为什么
""".split()
)

ENGLISH = tuple(
    """
be he me we if of am an in on do no so to up or as is at it by my had did old and see she the one
are use off all him can own who too two her for nor our has was his its get not but out you few new
how now day may say way why any boy try said good once make take like same time some here were more
have long each much such with both tell well will them whom from than been then when down into over
your does this hers ours that what want most just know they only many very could would while there
where these those above being doing which think until shall still again under other after never
their yours great might ought first about below should before itself myself during having theirs
cannot because himself herself through between further against yourself ourselves themselves
yourselves
""".split()
)

STOP_WORDS = CHINESE + ENGLISH
